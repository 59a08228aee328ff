"""Vector retrieval: exact search for tables of queries, an inverted file for approximate search, and maintenance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbra.operators.keyword import top
from lumbra.operators.sizes import small
from lumbra.session import cut

#: Bytes of the queries' numbers that one pass over the vectors takes; they are broadcast to every executor as a matrix.
BLOCK_BYTES = 32 << 20


def metadata_filter(df: DataFrame, want: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """Rows whose metadata has all these values as text; an absent key fails, no condition passes all."""
    for key, value in want.items():
        df = df.filter(F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)) == value, F.lit(False)))
    return df


def check_dimension(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The same rows; the query fails on a vector of another length."""
    wrong = F.concat(F.lit(f"vector dimension: want {dim}, got "), F.size(vector))
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(wrong).cast("array<double>")))


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The queries' ids and numbers, in blocks of at most about BLOCK_BYTES; each block has vectors of one length. Null vectors are left out."""
    rows = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("d"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    if sizes:
        rows = cut(rows, "queries")
    for d, n in sizes:
        parts = max(1, -(-n * max(d, 1) * 8 // BLOCK_BYTES))
        for i in range(parts):
            got = rows.filter((F.col("d") == d) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()
            if got:
                yield [r[0] for r in got], np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), d)


def similarities(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Cosine (0 for vectors of unequal length or without a direction) or the negative distance (the largest float for unequal lengths) of each query and vector."""
    if q.shape[1] != x.shape[1]:
        return np.full((len(q), len(x)), 0.0 if metric == "cosine" else -float(np.finfo(np.float32).max))
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "cosine":
            s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
            return np.nan_to_num(s, nan=0.0, posinf=0.0, neginf=0.0)
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))


def _best(ids: list, which: np.ndarray, names: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query the k best of these vectors, and those that are as good; all of them for k <= 0."""
    n = min(k, s.shape[1]) if k > 0 else s.shape[1]
    kth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    r, c = np.nonzero(s >= (kth - 1e-9)[:, None])
    return pd.DataFrame({"query_id": pd.Series([ids[which[i]] for i in r], dtype=object), "id": names[c], "score": s[r, c]})


def _search(shared, k: int, metric: str) -> Callable:
    """Best k of each query within each batch of vectors, by one matrix product."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for b in batches:
            size = b["vector"].map(len).to_numpy()
            for d in np.unique(size):
                part = b[size == d]
                yield _best(ids, np.arange(len(ids)), part["id"].to_numpy(), similarities(q, np.stack(part["vector"].to_numpy()).astype(np.float64), metric), k)

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, where: dict[str, str] | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors of each query, exactly; all of them for k <= 0. metric is cosine or l2 (score = -distance).

    Vectors stay where they are: every task multiplies its own with a broadcast block of queries and passes on k of each query; further blocks are further
    passes. Metadata conditions hold before the search. Vectors of another length than the query's are the least similar ones.
    """
    rows = metadata_filter(vectors, where or {}).filter("vector is not null").select("id", F.col("vector").cast("array<double>"))
    kind, key = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["id"]
    schema = f"query_id {kind}, id {key}, score double"
    spark, found = vectors.sparkSession, None
    for block in _blocks(queries):
        hits = rows.mapInPandas(_search(spark.sparkContext.broadcast(block), k, metric), schema)
        found = hits if found is None else found.unionByName(hits)
    return top(found if found is not None else spark.createDataFrame([], schema), k)


def hnsw_search(vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = 50, where: dict[str, str] | None = None) -> DataFrame:
    """What a graph search with perfect recall returns: the max(ef, k) nearest by distance, of those the ones that meet the conditions, k at most; score 1 / (1 + d)."""
    near = knn(vectors, queries, max(ef, k), metric="l2").drop("rank")
    keep = near.join(metadata_filter(vectors, where).select("id"), "id", "left_semi") if where else near
    return top(keep.withColumn("score", 1 / (1 - F.col("score"))), k)


def multi_query(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries has group_id and ord: of each id the hit of a group's first query counts, then the k best scores. Not the best score of each id."""
    hits = knn(vectors, queries, k).drop("rank").join(small(queries.select("query_id", "group_id", "ord")), "query_id")
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("group_id", "id").orderBy("ord"))).filter("_n = 1")
    return top(first.select(F.col("group_id").alias("query_id"), "id", "score"), k)


def upsert(vectors: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """New rows replace those with the same id; of several new ones the latest created_at counts. A null id becomes one made from the vector."""
    new = new.withColumn("id", F.coalesce("id", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256).cast(dict(new.dtypes)["id"])))
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("created_at").desc()))).filter("_n = 1").drop("_n")
    return vectors.join(last.select("id"), "id", "left_anti").unionByName(check_dimension(last, dim), allowMissingColumns=True)


def delete(vectors: DataFrame, ids: DataFrame | None = None, where: dict[str, str] | None = None) -> DataFrame:
    """Rows that are neither among ids nor meet the conditions; conditions that are empty delete nothing."""
    out = vectors.join(ids.select("id"), "id", "left_anti") if ids is not None else vectors
    return out.join(metadata_filter(out, where).select("id"), "id", "left_anti") if where else out


def stats(vectors: DataFrame) -> DataFrame:
    """One row: vectors, distinct ids, smallest and largest dimension."""
    return vectors.agg(F.count("*").alias("vectors"), F.count_distinct("id").alias("ids"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"))


class Ivf:
    """An inverted file: k-means cells fitted on a bounded sample, all vectors assigned to their nearest cell and written once in the order of cells."""

    #: Vectors that the cells are fitted on, whatever the table's size.
    SAMPLE = 50_000

    def __init__(self, vectors: DataFrame, lists: int = 100, seed: int = 7, rounds: int = 15) -> None:
        part = vectors.filter("vector is not null").select("id", F.col("vector").cast("array<double>"))
        sample = part.orderBy(F.xxhash64("id", F.lit(seed))).limit(self.SAMPLE).select("vector").collect()
        # the length that most vectors have; others are in no cell
        size = Counter(len(r[0]) for r in sample).most_common(1)
        x = np.array([r[0] for r in sample if len(r[0]) == size[0][0]]) if sample else np.zeros((1, 1))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        lists = max(1, min(lists, len(x)))
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            full = np.bincount(own, minlength=lists) > 0
            c = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), c)
        self.centres = c
        # a large cell lies in several parts, and each part searches its own
        self.cells = cut(self.assign(part).repartitionByRange("cell", "id").sortWithinPartitions("cell"), "cells")

    def assign(self, vectors: DataFrame) -> DataFrame:
        """(id, vector, cell): the nearest cell of each vector. A vector of another length than the cells' is in none."""
        c = self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[b["vector"].map(len).to_numpy() == c.shape[1]]
                if len(b):
                    s = np.stack(b["vector"].to_numpy()) @ c.T
                    yield pd.DataFrame({"id": b["id"].to_numpy(), "vector": b["vector"].to_numpy(), "cell": s.argmax(1)})

        return vectors.mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, vector array<double>, cell int")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 10) -> DataFrame:
        """(query_id, id, score, rank) from the probes nearest cells of each query. More probes, more recall.

        The vectors stay in their cells: a broadcast block of queries meets, by one matrix product a cell, those cells that it probes.
        """
        kind, key = dict(queries.dtypes)["query_id"], dict(self.cells.dtypes)["id"]
        schema = f"query_id {kind}, id {key}, score double"
        spark, found, c = self.cells.sparkSession, None, self.centres
        for ids, q in _blocks(queries):
            if q.shape[1] != c.shape[1]:
                continue
            near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
            asked = {cell: np.flatnonzero((near == cell).any(1)) for cell in np.unique(near)}
            shared = spark.sparkContext.broadcast((ids, q, asked))

            def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                ids, q, asked = shared.value
                for b in batches:
                    x, cells, names = np.stack(b["vector"].to_numpy()) if len(b) else None, b["cell"].to_numpy(), b["id"].to_numpy()
                    for cell in np.unique(cells):
                        which = asked.get(cell)
                        if which is not None:
                            at = cells == cell
                            yield _best(ids, which, names[at], similarities(q[which], x[at], "cosine"), k)

            hits = self.cells.filter(F.col("cell").isin([int(x) for x in asked])).mapInPandas(run, schema)
            found = hits if found is None else found.unionByName(hits)
        return top(found if found is not None else spark.createDataFrame([], schema), k)
