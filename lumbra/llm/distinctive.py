"""Problem 6: how distinctive a term is of a record, by a parsimonious language model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.llm.common import HAN, join_hot, py_tokens
from lumbra.session import cut

#: Share of the record's own model in the mixture, and when the expectation-maximisation ends.
OWN, STEPS, EPS = 0.1, 60, 1e-7
#: The background is broadcast up to so many terms (about 60 MB in a worker); beyond it, terms meet it in a join.
BROADCAST_TERMS = 1_000_000
_HAN = re.compile(f"[{HAN}]")
_OUT = "table_name string, record_id string, term string, tf long, df long, score double"


def records(df: DataFrame, table_name: str, id_col: str) -> DataFrame:
    """(table_name, record_id, content): repeated ids once, of different rows the latest, then the larger content. Null ids are left out; a null content has no term."""
    row = F.struct("created_at", F.coalesce("content", F.lit("")).alias("content"))
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("record_id"), row.alias("row"))
    return rows.groupBy("record_id").agg(F.max("row").alias("row")).select(F.lit(table_name).alias("table_name"), "record_id", F.col("row.content").alias("content"))


def _text(values) -> pd.Series:
    """Python strings as they are: pandas' own string type may come in several chunks, which Arrow's record batches don't take."""
    return pd.Series(list(values), dtype=object)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cf: Counter = Counter()
    df: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = list(cf)
        out = pd.DataFrame({"table_name": _text(k[0] for k in keys), "term": _text(k[1] for k in keys), "cf": [cf[k] for k in keys], "df": [df[k] for k in keys]})
        cf.clear()
        df.clear()
        return out

    for b in batches:
        for table, content in zip(b["table_name"], b["content"], strict=True):
            n = Counter(py_tokens(content))
            for term, tf in n.items():
                cf[table, term] += tf
                df[table, term] += 1
            if len(cf) > 300_000:
                yield flush()
    if cf:
        yield flush()


def background(recs: DataFrame) -> DataFrame:
    """(table_name, term, cf, df) over all records; counts are combined in each task before the shuffle."""
    return recs.mapInPandas(_count, "table_name string, term string, cf long, df long").groupBy("table_name", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def parsimonious(record: np.ndarray, tf: np.ndarray, p_background: np.ndarray) -> np.ndarray:
    """Converged P(term | record) of all postings; record numbers rise from 0. What the background explains loses its mass to the rest."""
    n = int(record[-1]) + 1 if len(record) else 0
    tf = tf.astype(float)
    p = tf / np.bincount(record, tf, n)[record]
    rest = (1 - OWN) * p_background
    starts = np.flatnonzero(np.r_[True, record[1:] != record[:-1]]) if n else np.empty(0, int)
    # a record rests once it has converged by itself, so its scores don't depend on the records beside it
    moving = np.ones(n, bool)
    for _ in range(STEPS):
        e = tf * (OWN * p) / (rest + OWN * p)
        q = np.where(moving[record], e / np.bincount(record, e, n)[record], p)
        moving &= np.maximum.reduceat(np.abs(q - p), starts) >= EPS if n else False
        p = q
        if not moving.any():
            break
    return p


class Keep:
    """Which postings are given out; the model is always fitted on all terms of a record."""

    def __init__(self, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, min_length: int = 1, han: bool = True) -> None:
        self.min_tf, self.min_df, self.max_df, self.min_length, self.han = min_tf, min_df, max_df, min_length, han

    def __call__(self, terms: list[str], tf: np.ndarray, df: np.ndarray) -> np.ndarray:
        ok = (tf >= self.min_tf) & (df >= self.min_df)
        if self.max_df is not None:
            ok &= df <= self.max_df
        for i in np.flatnonzero(ok):
            t = terms[i]
            ok[i] = len(t) >= self.min_length and (self.han or not _HAN.search(t))
        return ok


def _scored(keep: Keep, totals: dict[str, int], shared) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            for start in range(0, len(b), 2000):
                part = b.iloc[start : start + 2000]
                rec: list[int] = []
                terms: list[str] = []
                tfs: list[int] = []
                cfs: list[int] = []
                dfs: list[int] = []
                total: list[int] = []
                who: list[int] = []
                n = 0
                for i, (table, content) in enumerate(zip(part["table_name"], part["content"], strict=True)):
                    counts = Counter(py_tokens(content))
                    if not counts:
                        continue
                    for term, tf in counts.items():
                        # a term that isn't shared occurs in this record only
                        cf, df = known.get((table, term), (tf, 1))
                        terms.append(term)
                        tfs.append(tf)
                        cfs.append(cf)
                        dfs.append(df)
                    rec += [n] * len(counts)
                    total += [totals[table]] * len(counts)
                    who.append(i)
                    n += 1
                if not rec:
                    continue
                r, tf, df = np.array(rec), np.array(tfs), np.array(dfs)
                score = parsimonious(r, tf, np.array(cfs) / np.array(total))
                at = np.flatnonzero(keep(terms, tf, df))
                if len(at):
                    rows = part.iloc[np.array(who)[r[at]]]
                    yield pd.DataFrame({"table_name": _text(rows["table_name"]), "record_id": _text(rows["record_id"]), "term": _text(terms[i] for i in at), "tf": tf[at], "df": df[at], "score": score[at]})

    return run


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, r, w, n) for t, r, c in zip(b["table_name"], b["record_id"], b["content"], strict=True) for w, n in Counter(py_tokens(c)).items()]
        t, r, w, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pd.DataFrame({"table_name": _text(t), "record_id": _text(r), "term": _text(w), "tf": np.array(n, np.int64)})


def _scored_lists(keep: Keep) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for table, record, ps in zip(b["table_name"], b["record_id"], b["ps"], strict=True):
                terms = [p["term"] for p in ps]
                tf, df, pc = (np.array([p[k] for p in ps]) for k in ("tf", "df", "pc"))
                score = parsimonious(np.zeros(len(ps), int), tf, pc)
                at = np.flatnonzero(keep(terms, tf, df))
                yield pd.DataFrame({"table_name": _text([table] * len(at)), "record_id": _text([record] * len(at)), "term": _text(terms[i] for i in at), "tf": tf[at], "df": df[at], "score": score[at]})

    return run


def scores(recs: DataFrame, keep: Keep | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(table_name, record_id, term, tf, df, score): the term's converged probability in its record.

    Terms of only one record need no background: all their occurrences are in it. The others are counted first; if there are
    at most broadcast_terms, every worker gets them, and records are tokenised where they are; else postings join them.
    Records without a term give no row. Ties share their score.
    """
    keep = keep or Keep()
    spark = recs.sparkSession
    recs = cut(recs, "records")
    back = cut(background(recs), "background")
    totals = {r[0]: r[1] for r in back.groupBy("table_name").agg(F.sum("cf")).collect()}
    shared = back.filter("df > 1")
    if shared.count() <= broadcast_terms:
        known: dict = {}
        for r in shared.toLocalIterator(prefetchPartitions=True):
            known[r[0], r[1]] = (r[2], r[3])
        return recs.mapInPandas(_scored(keep, totals, spark.sparkContext.broadcast(known)), _OUT)
    share = F.create_map(*[x for t, n in totals.items() for x in (F.lit(t), F.lit(float(n)))])
    back = back.withColumn("pc", F.col("cf") / share[F.col("table_name")])
    posts = cut(recs.mapInPandas(_postings, "table_name string, record_id string, term string, tf long"), "postings")
    # a common word is a key of very many postings: those of the commonest ones stay where they are
    posts = join_hot(posts, back.drop("cf"), ["table_name", "term"], "df", posts.count())
    lists = posts.groupBy("table_name", "record_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df", "pc"))).alias("ps"))
    return lists.mapInPandas(_scored_lists(keep), _OUT)
