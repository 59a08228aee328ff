"""What several operators share: tokens, settings and components; skew-safe joins and prefix sums come from the core."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.operators.skew import join_hot, running_total  # noqa: F401
from lumbra.session import cut

#: A maximal run of letters and digits, or one Han character.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
#: The Han characters, as Unicode's script property has them in the basic and supplementary planes.
HAN = "\u2e80-\u2e99\u2e9b-\u2ef3\u2f00-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufa6d\ufa70-\ufad9\U00020000-\U000323af"
PY_TOKEN = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def py_tokens(text: str) -> list[str]:
    return PY_TOKEN.findall(text.lower())


@contextmanager
def setting(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id that each id is connected with. Ids without an edge do not appear.

    Large-star and small-star in turn: each id links its larger, then its smaller neighbours to the smallest one it sees. Every round
    moves as many rows as there are edges and is written to the shared folder; groups are only aggregated, never collected.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components: no fixed point yet; raise rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
