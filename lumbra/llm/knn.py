"""Problem 4: the most similar vectors of every vector, by a block matrix join on 8-bit tiles."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbra.llm.common import join_hot, setting
from lumbra.session import cut

#: Rows and columns of one product tile; a tile of similarities takes 4 MB.
TILE = 1024
#: Columns of a tile of which only the largest product is compared with a row's bound at first.
FOLD = 16
#: Where a tile has no pair; below any product less any error.
ABSENT = -9
#: Vectors in one block of the grid, at least; blocks are never smaller, so that few vectors don't make many tasks.
BLOCK = 4096
#: Vectors in one block, at most: each vector goes to one cell for each block, and two blocks have to fit into a task.
LARGEST = 131072
#: Vectors that are sorted into blocks at once.
PACK = 32768
#: Pairs that a block holds before those that its bounds have ruled out are dropped.
KEPT = 1 << 20


def _units(dim: int, kind: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("v")), dim), False))
            # a null number is read as one that isn't finite
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x, ids = x[fine], b.column("id").filter(pa.array(fine))
            x = x / np.abs(x).max(1, initial=0, keepdims=True)
            # summed from the first number to the last, so that the row's place in a batch doesn't count
            x = x / np.sqrt(np.cumsum(x * x, 1)[:, -1:])
            if packed:
                c = [int.from_bytes(blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in np.rint(x * 1e12).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "c", "v"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])

    return run, f"id {kind}, c long, v binary" if packed else f"id {kind}, v array<double>"


def latest(vectors: DataFrame, dim: int = 64, packed: bool = False) -> DataFrame:
    """(id, v): the row of each id with the latest created_at, from vector or else embedding, as a unit vector of doubles.

    Ids whose latest row is not dim finite numbers, or all zero, are left out; so are null ids. A null created_at counts as
    earliest; of rows with equal times the larger vector wins, then the larger text, so that the result doesn't depend on the order of rows.
    packed: (id, c, v) with v as bytes and c, the same for vectors that are equal to twelve decimals.
    """
    text = F.expr("transform(split(regexp_replace(embedding, '[\\\\[\\\\]\\\\s]', ''), ','), x -> try_cast(x as double))")
    row = F.struct(F.col("created_at").alias("t"), "vector", "embedding")
    rows = vectors.filter("id is not null").groupBy("id").agg(F.max(row).alias("row")).select("id", "row.vector", "row.embedding")
    # only the rows that count are read from their text, and each once: conditions on v in SQL would be put in its place and read it again
    return rows.select("id", F.coalesce(F.col("vector").cast("array<double>"), text).alias("v")).mapInArrow(*_units(dim, dict(rows.dtypes)["id"], packed))


def _coded(dim: int, side: int):
    """Two bytes for each number: the first gives the tile products, the second refines the pairs that survive. Rows of the result hold many vectors of one block."""

    def pack(c: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        order = np.argsort(c % side, kind="stable")
        c, x = c[order], x[order]
        s = (np.abs(x).max(1) / 127).astype(np.float32).astype(np.float64)
        hi = np.clip(np.rint(x / s[:, None]), -127, 127)
        lo = np.clip(np.rint((x / s[:, None] - hi) * 254), -127, 127)
        e1 = np.sqrt(((x - hi * s[:, None]) ** 2).sum(1)) + 1e-6
        e2 = np.sqrt(((x - (hi + lo / 254) * s[:, None]) ** 2).sum(1)) + 1e-6
        block, first = np.unique(c % side, return_index=True)
        columns = {"c": c, "hi": hi.astype(np.int8), "lo": lo.astype(np.int8), "s": s.astype(np.float32), "e1": e1, "e2": e2}
        return pd.DataFrame({"block": block} | {name: [part.tobytes() for part in np.split(values, first[1:])] for name, values in columns.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in (*batches, None):
            if b is not None and len(b):
                held.append(b)
            if held and (b is None or sum(map(len, held)) >= PACK):
                rows = pd.concat(held)
                held = []
                yield pack(rows["c"].to_numpy(np.int64), np.frombuffer(b"".join(rows["v"]), np.float64).reshape(-1, dim))

    return run


def _where(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero in the order in which hit lies in memory."""
    if hit.flags.c_contiguous:
        return np.divmod(np.flatnonzero(hit), hit.shape[1])
    return np.divmod(np.flatnonzero(hit.T), hit.shape[0])[::-1]


class _Side:
    """One block: ids, codes, error norms, and for each row the k best lower bounds so far."""

    def __init__(self, rows: pd.DataFrame, k: int, floor: float, dim: int) -> None:
        def read(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(rows[name]), kind)

        self.c, self.s = read("c", np.int64), read("s", np.float32)
        self.hi = read("hi", np.int8).reshape(-1, dim)
        self.both = self.hi * np.int16(254) + read("lo", np.int8).reshape(-1, dim)
        self.e1, self.e2 = read("e1", np.float64), read("e2", np.float64)
        self.best = np.full((len(self.c), k), floor, np.float64)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.bound = 0, KEPT

    def tile(self, rows: slice) -> np.ndarray:
        return self.hi[rows].astype(np.float32) * self.s[rows, None]

    def full(self, rows: np.ndarray) -> np.ndarray:
        return self.both[rows] * (self.s[rows, None] / np.float32(254))

    def add(self, r: np.ndarray, other: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> None:
        """The pairs survive whose upper bound reaches the row's k-th best lower bound; both are merged into the rows' heaps."""
        keep = ub >= self.best[r, 0]
        r, other, lb, ub = r[keep], other[keep], lb[keep], ub[keep]
        if not len(r):
            return
        order = np.lexsort((-lb, r))
        r, other, lb, ub = r[order], other[order], lb[order], ub[order]
        first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        pos = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        k = self.best.shape[1]
        new = np.full((len(first), k), -2.0)
        top = pos < k
        new[np.searchsorted(r[first], r[top]), pos[top]] = lb[top]
        rows = r[first]
        both = np.sort(np.concatenate([self.best[rows], new], 1), 1)
        self.best[rows] = both[:, -k:]
        self.kept.append((r, other, lb, ub))
        self.held += len(r)
        if self.held > self.bound:
            self.prune()

    def prune(self) -> None:
        """Drops what the bounds have ruled out since; the next time comes when the pairs have doubled."""
        r, other, lb, ub = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        keep = ub >= self.best[r, 0]
        self.kept = [(r[keep], other[keep], lb[keep], ub[keep])]
        self.held = int(keep.sum())
        self.bound = max(KEPT, 2 * self.held)

    def meet(self, start: int, sims: np.ndarray, other: _Side, across: int, slack: float) -> None:
        """A tile of products of the rows from start on with other's rows from across on, each off by slack at most: pairs that may be among a row's k best are refined and added."""
        k, size, top = self.best.shape[1], len(sims), sims
        groups = size
        # of the columns t, t + groups, t + 2 * groups, ... only the largest product
        while groups > size // FOLD and groups % 2 == 0:
            groups //= 2
            top = np.maximum(top[:, :groups], top[:, groups:])
        rows = slice(start, start + size)
        top = top[: len(self.best[rows])]
        hit = top >= (self.best[rows, 0] - slack).astype(np.float32)[:, None]
        if groups >= k and np.count_nonzero(hit) > 2 * k * len(hit):
            # rows that know too little yet: each has k vectors at or above the k-th best of its groups less the error, so no bound of it need be lower
            kth = np.partition(top, groups - k, axis=1)[:, groups - k].astype(np.float64) - slack
            self.best[rows] = np.maximum(self.best[rows], kth[:, None])
            hit = top >= (self.best[rows, 0] - slack).astype(np.float32)[:, None]
        r, t = _where(hit)
        flat = sims.ravel() if sims.flags.c_contiguous else sims.T.ravel()
        step = (size, 1) if sims.flags.c_contiguous else (1, size)
        for m in range(0, len(r), 1 << 17):
            rr, c = r[m : m + (1 << 17)], t[m : m + (1 << 17), None] + np.arange(0, size, groups)
            i, j = _where(flat.take(rr[:, None] * step[0] + c * step[1]) >= (self.best[start + rr, 0] - slack).astype(np.float32)[:, None])
            a, b = start + rr[i], across + c[i, j]
            value = np.einsum("ij,ij->i", self.full(a), other.full(b)).astype(np.float64)
            slip = self.e2[a] * (1 + other.e2[b]) + other.e2[b] + 1e-6
            self.add(a, other.c[b], value - slip, value + slip)

    def survivors(self) -> pd.DataFrame:
        if not self.kept:
            return pd.DataFrame({"a": [], "b": [], "lb": [], "ub": []})
        self.prune()
        r, other, lb, ub = self.kept[0]
        return pd.DataFrame({"a": self.c[r], "b": other, "lb": lb, "ub": ub})


def _cell(k: int, floor: float, dim: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        x = _Side(left, k, floor, dim) if len(left) else None
        y = x if same else (_Side(right, k, floor, dim) if len(right) else None)
        if x is None or y is None:
            return pd.DataFrame({"a": [], "b": [], "lb": [], "ub": []})
        sims = np.empty((TILE, TILE), np.float32)
        for i in range(0, len(x.c), TILE):
            p = slice(i, i + TILE)
            rows = x.tile(p)
            for j in range(i if same else 0, len(y.c), TILE):
                q = slice(j, j + TILE)
                columns = y.tile(q)
                if len(rows) < TILE or len(columns) < TILE:
                    sims.fill(ABSENT)
                np.matmul(rows, columns.T, out=sims[: len(rows), : len(columns)])
                # the errors of the codes, and of numbers and products in single precision
                slack = float(x.e1[p].max() * (1 + y.e1[q].max()) + y.e1[q].max() + 2e-5)
                if same and i == j:
                    np.fill_diagonal(sims, ABSENT)
                    x.meet(i, sims, x, i, slack)
                else:
                    x.meet(i, sims, y, j, slack)
                    y.meet(j, sims.T, x, i, slack)
        return x.survivors() if same else pd.concat([x.survivors(), y.survivors()])

    return run


def _dot(dim: int):
    @F.pandas_udf(T.DoubleType())
    def dot(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", *(np.frombuffer(b"".join(x), np.float64).reshape(-1, dim) for x in (a, b))))

    return dot


def neighbours(vectors: DataFrame, k: int = 5, floor: float = -1.0, dim: int = 64, parallel: int | None = None) -> DataFrame:
    """(id, neighbour, rank, similarity): the k vectors that point most nearly the same way as each one, ties (to twelve decimals) by id; none below floor.

    Equal vectors are one class of the join, so no group of copies is paired out: of each class only its k + 1 smallest ids can
    be anyone's neighbour. Classes fall into about sqrt(2 * parallel) blocks (or more, about LARGEST vectors each at most); every pair of
    blocks is one task over 8-bit tiles. The result is exact, whatever the tiles' error: bounds only drop pairs that can't be among the k best.
    """
    spark = vectors.sparkSession
    parallel = parallel or 4 * spark.sparkContext.defaultParallelism
    rows = cut(latest(vectors, dim, packed=True), "unit")
    by = Window.partitionBy("c").orderBy("id")
    sizes = rows.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    if sizes.filter("size > 1").isEmpty():
        classes = rows.select("c", "id", "v", F.array("id").alias("ids"))
    else:
        # smallest ids of each class by repeated aggregation over salted parts, so that no class is sorted in one task
        part = rows.select("c", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
        low = part.withColumn("n", F.row_number().over(Window.partitionBy("c", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
        low = low.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        classes = rows.join(sizes.select(F.col("low").alias("id")), "id").join(low, "c").select("c", "id", "v", "ids")
    classes = cut(classes, "classes")
    count = classes.count()
    side = max(1, min(int((2 * parallel) ** 0.5), -(-count // BLOCK)), -(-count // LARGEST))
    code = "block long, c binary, hi binary, lo binary, s binary, e1 binary, e2 binary"
    coded = cut(classes.select("c", "v").mapInPandas(_coded(dim, side), code), "coded")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    spread = coded.select("*", F.explode(others).alias("at")).select("at.i", "at.j", *coded.columns)
    left = spread.filter("block = i")
    right = spread.filter("block = j")
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_cell(k, floor, dim), "a long, b long, lb double, ub double")
    # a cell has few bytes and much work: cells are spread over many small tasks, which the planner would join by their bytes
    with setting(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(4 * side * side)}):
        pairs = cut(pairs, "survivors")
    if side > 1:
        ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("lb").desc())))
        kth = ranked.filter(F.col("n") == k).select("a", F.col("lb").alias("kth"))
        pairs = pairs.join(kth, "a", "left").filter("kth is null or ub >= kth")
    value = classes.select("c", "v")
    once = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    exact = once.join(value.select(F.col("c").alias("x"), F.col("v").alias("vx")), "x").join(value.select(F.col("c").alias("y"), F.col("v").alias("vy")), "y")
    exact = cut(exact.select("x", "y", F.round(_dot(dim)("vx", "vy"), 12).alias("similarity")).filter(F.col("similarity") >= floor), "exact")
    both = exact.select(F.col("x").alias("c"), F.col("y").alias("d"), "similarity").unionByName(exact.select(F.col("y").alias("c"), F.col("x").alias("d"), "similarity"))
    near = both.join(classes.select(F.col("c").alias("d"), "ids"), "d").select("c", "similarity", F.explode("ids").alias("neighbour"))
    own = classes.filter(F.size("ids") > 1).select("c", F.lit(1.0).alias("similarity"), F.explode("ids").alias("neighbour")).filter(F.lit(1.0) >= floor)
    best = Window.partitionBy("c").orderBy(F.col("similarity").desc(), "neighbour")
    short = near.unionByName(own).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    # a member of a class takes the k first of the class's k + 1 that aren't itself
    lists = short.groupBy("c").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))).alias("all"))
    mine = join_hot(rows.select("c", "id"), lists.join(sizes.select("c", "size"), "c"), ["c"], "size", rows.count()).select("id", F.slice(F.filter("all", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("all"))
    return mine.select("id", F.posexplode("all").alias("rank", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("x.s")).alias("similarity"))


def mutual(vectors: DataFrame, k: int = 5, floor: float = 0.93, dim: int = 64) -> DataFrame:
    """(id_a, id_b): pairs that are each among the other's k nearest and reach the floor."""
    n = cut(neighbours(vectors, k, dim=dim), "neighbours").filter(F.col("similarity") >= floor).select("id", "neighbour")
    back = n.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    return n.filter("id < neighbour").join(back, ["id", "neighbour"]).select(F.col("id").alias("id_a"), F.col("neighbour").alias("id_b"))
