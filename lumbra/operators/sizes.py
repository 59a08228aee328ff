"""Broadcasts whose size is checked."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.session import cut

#: Rows and bytes of the written table up to which a side is small enough for every executor.
SMALL, BYTES = 20_000, 32 << 20
#: Queries that one pass takes where every task compares all of them with its rows.
QUERIES = 10_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, written once, with a broadcast hint if it has at most so many rows and bytes; else without, and the join shuffles."""
    df = cut(df, "small")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BYTES and df.count() <= rows else df


def one_row(df: DataFrame) -> DataFrame:
    """For the result of a global aggregate, which has exactly one row."""
    return F.broadcast(df)


def in_parts(search: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A search (table, queries, ...) that compares each query with each row: more than QUERIES queries are answered in parts, one pass over the table each."""

    @wraps(search)
    def run(table, queries: DataFrame, *args, **options) -> DataFrame:
        n = queries.count()
        if n <= QUERIES:
            return search(table, queries, *args, **options)
        parts, out = -(-n // QUERIES) + 1, None
        queries = cut(queries.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "queries")
        for i in range(parts):
            found = search(table, queries.filter(F.col("_part") == i).drop("_part"), *args, **options)
            out = found if out is None else out.unionByName(found)
        return out

    return run
