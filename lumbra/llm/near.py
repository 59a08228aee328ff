"""Problem 5: records that share most of their content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbra.llm.common import components, join_hot, py_tokens
from lumbra.llm.copies import canonical
from lumbra.session import cut

#: BINS = BANDS * ROWS values of one permutation. Two texts of similarity s share a band with probability 1 - (1 - s^3)^42: 0.99997 at 0.6.
BANDS, ROWS = 42, 3
BINS = BANDS * ROWS
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20170417)
#: Optimal densification: each empty bin tries the others in its own random order and takes the first one that is filled.
_PROBE = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_ODD = _rng.integers(1, 2**63, size=ROWS + 1, dtype=np.uint64) | np.uint64(1)
_BAND_SEED = _rng.integers(0, 2**63, size=BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(ids: np.ndarray, run: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of successive tokens; none if there are fewer tokens than a run has."""
    if len(ids) < run:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - run + 1, np.uint64)
    for i in range(run):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + ids[i : len(ids) - run + 1 + i])
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation hashing: the smallest value of each bin, empty bins filled by optimal densification."""
    values = np.full(BINS, _NONE)
    np.minimum.at(values, (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
    empty = np.flatnonzero(values == _NONE)
    if len(empty):
        filled = values != _NONE
        probes = _PROBE[empty]
        values[empty] = values[probes[np.arange(len(empty)), filled[probes].argmax(1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    h = _BAND_SEED.copy()
    for i in range(ROWS):
        h = _mix(h * _ODD[i] + rows[:, i])
    return h.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int32()), ("est", pa.binary()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])
_SIGNED_DDL = "doc_id long, h1 long, h2 long, t1 long, t2 long, n int, est binary, bands array<long>, shingles binary"


def _signer(run: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, h1, h2, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "content")), strict=True):
                words = py_tokens(content)
                if len(words) < run:
                    continue
                if len(known) > 500_000:
                    known.clear()
                ids = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) or 1) for w in words), np.uint64, len(words))
                h = shingles(ids, run)
                values = sketch(h)
                t = xxhash.xxh3_128_digest(ids.tobytes())
                out.append((doc, h1, h2, int.from_bytes(t[:8], "big", signed=True), int.from_bytes(t[8:], "big", signed=True), len(h), (values & np.uint64(255)).astype(np.uint8).tobytes(), bands(values), h.tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(cols[:7], _SIGNED, strict=False)]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(cols[7]))))
                arrays.append(pa.array(cols[8], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, schema=_SIGNED)

    return sign


def signatures(docs: DataFrame, run: int = 3, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """One row for each document with at least one run of tokens: its copy class (h1, h2), token hash (t1, t2), sketch, band keys and shingles."""
    text = docs.filter(F.col(content).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"))
    digest = F.unhex(F.md5(canonical(F.col("content"))))
    half = [F.conv(F.hex(F.substring(digest, i, 8)), 16, -10).cast("long") for i in (1, 9)]
    return text.select("doc_id", half[0].alias("h1"), half[1].alias("h2"), "content").mapInArrow(_signer(run), _SIGNED_DDL)


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:


    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / (len(x) + len(y) - both)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:


    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), BINS)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), BINS)
    return pd.Series((x == y).mean(1))


class Near:
    """The tables of one run: signed documents, one representative for each text, and verified pairs of representatives."""

    def __init__(self, docs: DataFrame, least: float = 0.6, run: int = 3, id_col: str = "doc_id", content: str = "content") -> None:
        self.least = least
        self.signed = cut(signatures(docs, run, id_col, content), "signed")
        text = ["t1", "t2", "h1", "h2"]
        classes = self.signed.groupBy(*text).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        #: rep, copies and the signature of one document for each distinct token sequence within a set of copies
        self.reps = cut(self.signed.drop("shingles").join(classes.select(F.col("rep").alias("doc_id"), "copies"), "doc_id").withColumnRenamed("doc_id", "rep"), "reps")
        self.count = self.reps.count()
        self.text = text

    def members(self) -> DataFrame:
        """(doc_id, rep, copies) of every signed document; texts with many copies don't meet in one task."""
        narrow = self.signed.select("doc_id", *self.text)
        return join_hot(narrow, self.reps.select(*self.text, "rep", "copies"), self.text, "copies", self.signed.count()).select("doc_id", "rep", "copies")

    def candidates(self) -> DataFrame:
        """(a, b): in each bucket of each band an edge from the bucket's centre to every other text in it.

        The centre is the least id after XOR with a hash of the bucket: another one in each bucket, found by aggregation alone.
        A second star leads from the largest id after the same XOR. Edges are at most twice the rows of the buckets.
        """
        rows = self.reps.select("rep", F.explode("bands").alias("bucket"))
        keyed = F.col("rep").bitwiseXOR(F.xxhash64("bucket"))
        centres = rows.groupBy("bucket").agg(F.min(keyed).alias("lo"), F.max(keyed).alias("hi"), F.count("*").alias("size")).filter("size > 1")
        met = join_hot(rows, centres, ["bucket"], "size", self.count * BANDS)
        ends = F.explode(F.array_distinct(F.array("lo", "hi")))
        met = met.select("rep", "bucket", ends.alias("c")).select("rep", F.col("c").bitwiseXOR(F.xxhash64("bucket")).alias("c"))
        return met.filter("rep <> c").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()

    def checked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that reach the threshold. Sizes, then sketches, then the shingles themselves decide.

        Sketches only drop pairs whose estimate lies more than five standard deviations below the threshold.
        """
        floor = self.least - 5 * (self.least * (1 - self.least) / BINS) ** 0.5
        few = self.reps.select("rep", "n", "est", "h1", "h2")
        x = few.select(*[F.col(c).alias(f"{c}_a") for c in few.columns])
        y = few.select(*[F.col(c).alias(f"{c}_b") for c in few.columns])
        met = pairs.join(x, F.col("a") == F.col("rep_a")).join(y, F.col("b") == F.col("rep_b"))
        met = met.filter((F.least("n_a", "n_b") >= self.least * F.greatest("n_a", "n_b")) & ~((F.col("h1_a") == F.col("h1_b")) & (F.col("h2_a") == F.col("h2_b"))))
        likely = cut(met.filter(_estimate("est_a", "est_b") >= floor).select("a", "b"), "likely")
        need = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = cut(self.signed.select("doc_id", "shingles").join(need, "doc_id", "left_semi"), "sets")
        met = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        return met.select("a", "b", _jaccard("sa", "sb").alias("similarity")).filter(F.col("similarity") >= self.least - 1e-12)

    def pairs(self) -> DataFrame:
        """(a, b, similarity) of representatives. Stars leave out links between two satellites: those that are connected are checked as well."""
        star = cut(self.checked(self.candidates()), "star")
        self.roots = cut(components(star), "roots")
        rest = connected(star, self.roots, self.reps.select("rep", "n"), self.least).join(star.select("a", "b"), ["a", "b"], "left_anti")
        return star.unionByName(self.checked(cut(rest, "through")))


#: Members of a block: two blocks meet in at most its square of pairs, so no task has a hub or a family to itself.
BLOCK = 256


def connected(star: DataFrame, roots: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that have a common neighbour in star, of sizes that allow the similarity.

    Of each component either all pairs are taken, or the pairs around each of its members, whichever are fewer: a family of alike texts has
    many members that are everyone's neighbour, and would give each pair once for each of them. Groups are cut into blocks, and a pair of blocks
    is one key of the join, so the pairs of a large group are spread over all tasks.
    """
    ends = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = roots.select(F.col("id").alias("a"), "root")
    degree = ends.groupBy("a").agg(F.count("*").alias("d"))
    cost = degree.join(of, "a").groupBy("root").agg(F.count("*").alias("members"), F.sum(F.col("d") * F.col("d")).alias("around"))
    whole = cut(cost.select("root", "members", (F.col("members") * F.col("members") <= F.col("around")).alias("all")), "whole")
    n_roots = roots.count()
    marked = cut(join_hot(roots.withColumnRenamed("id", "rep"), whole, ["root"], "members", n_roots).select("rep", "root", "members", "all"), "marked")
    # (group, rep, size of the group)
    families = marked.filter("all").select(F.col("root").alias("g"), "rep", F.col("members").alias("size"))
    hubs = ends.join(marked.filter("not all").select(F.col("rep").alias("a")), "a").join(degree.filter("d > 1"), "a").select(F.col("a").alias("g"), F.col("b").alias("rep"), F.col("d").alias("size"))
    members = families.unionByName(hubs).join(sizes, "rep")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = cut(members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "g"), blocks).cast("int")), "members")
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = members.select("g", "rep", "n", "block", spread.alias("other")).filter("block <= other").select("g", F.col("block").alias("i"), F.col("other").alias("j"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    y = members.select("g", "rep", "n", "block", spread.alias("other")).filter("other <= block").select("g", F.col("other").alias("i"), F.col("block").alias("j"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    met = x.join(y, ["g", "i", "j"]).filter("ra <> rb and (i <> j or ra < rb)").filter(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    return met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


#: Copies of one text that meet its pairs in one part.
COPIES = 5000


def found(docs: DataFrame, least: float = 0.6, run: int = 3, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents at or above the threshold that are not in one set of copies.

    Null, empty and shorter texts than a run have no pair; copies of both sides are written out; ties at the threshold count.
    """
    near = Near(docs, least, run, id_col, content)
    pairs = cut(near.pairs(), "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    members = near.members().join(used, "rep", "left_semi").withColumn("salts", F.ceil(F.col("copies") / COPIES).cast("int"))
    members = cut(members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts").cast("int")), "members")
    salts = members.groupBy("rep").agg(F.max("salts").alias("salts"))

    def written_out(df: DataFrame, end: str, doc: str) -> DataFrame:
        # a text with very many copies is split into parts, and its pairs meet each of them
        df = df.join(salts.withColumnRenamed("rep", end), end).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return df.join(members.select(F.col("doc_id").alias(doc), F.col("rep").alias(end), "salt"), [end, "salt"]).drop("salt")

    met = written_out(written_out(pairs.select("a", "b"), "a", "da"), "b", "db")
    return met.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))


def grouped(docs: DataFrame, least: float = 0.6, run: int = 3, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, class_id, links): the group of every document that has a near duplicate or an equal token sequence, and its text's number of links."""
    near = Near(docs, least, run, id_col, content)
    pairs = cut(near.pairs(), "pairs")
    # pairs with a common neighbour connect nothing that isn't connected already
    roots = near.roots
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    of = roots.withColumnRenamed("id", "rep").join(links, "rep")
    members = near.members()
    return members.join(of, "rep", "left").filter("links is not null or copies > 1").select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
