"""Routing of queries and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.operators.keyword import top
from lumbra.operators.skew import numbered
from lumbra.session import cut

# What marks a query as a question for facts or for meaning.
FACTUAL = ("什么", "谁", "哪里", "什么时候", "多少", "what", "who", "where", "when", "how many")
SEMANTIC = ("为什么", "如何", "解释", "描述", "why", "how to", "explain", "describe")


def route(query: Column) -> Column:
    """The strategies for a query. Facts are tried first, so 为什么, which contains 什么, goes to keyword and graph."""
    q = F.lower(query)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    lists = lambda *names: F.array(*map(F.lit, names))
    return F.when(has(FACTUAL), lists("keyword", "graph")).when(has(SEMANTIC), lists("vector")).otherwise(lists("vector", "keyword"))


def ranks(hits: DataFrame) -> DataFrame:
    """Adds rank within query and strategy, best score first to nine decimals, ties by id."""
    return numbered(hits, ["query_id", "strategy"], [F.round("score", 9).desc(), F.col("id")], "rank")


def rrf(hits: DataFrame, k: int = 60, keep: int | None = 10, payload: str = "best") -> DataFrame:
    """Sum of 1 / (k + rank) over the strategies that found the item. hits: query_id, strategy, id, score, content.

    The content is that of the item's highest raw score, or with payload = 'first' of its alphabetically first strategy.
    """
    chosen = F.max_by("content", F.struct("score", "strategy")) if payload == "best" else F.min_by("content", F.struct("strategy", "rank"))
    fused = ranks(hits).groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), chosen.alias("content"))
    return top(fused, keep)


def weighted(hits: DataFrame, weights: dict[str, float], keep: int | None = 10) -> DataFrame:
    """Weighted mean of scores by strategy name; a strategy without a weight has 1 / number of the query's strategies. Without any weight nothing divides."""
    per = hits.select("query_id", "strategy").distinct().groupBy("query_id").agg(F.count("*").alias("_lists"))
    w = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
    rows = hits.join(per, "query_id").withColumn("_w", F.coalesce(F.try_element_at(w, F.col("strategy")), 1.0 / F.col("_lists")))
    total = rows.select("query_id", "strategy", "_w").distinct().groupBy("query_id").agg(F.sum("_w").alias("_total"))
    fused = rows.join(total, "query_id").groupBy("query_id", "id", "_total").agg(F.sum(F.col("score") * F.col("_w")).alias("_s"), F.max_by("content", "score").alias("content"))
    score = F.when(F.col("_total") > 0, F.col("_s") / F.col("_total")).otherwise(F.col("_s"))
    return top(fused.select("query_id", "id", score.alias("score"), "content"), keep)


Route = Callable[[DataFrame, int], DataFrame]


def hybrid(queries: DataFrame, routes: dict[str, Route], k: int = 10, method: str = "rrf", weights: dict[str, float] | None = None, rrf_k: int = 60, threshold: float | None = None) -> DataFrame:
    """Every route answers all queries with 2 k hits; the lists are fused. A route maps (queries, k) to query_id, id, score, content."""
    hits = None
    for name, run in routes.items():
        found = run(queries, 2 * k).select("query_id", F.lit(name).alias("strategy"), "id", "score", "content")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        raise ValueError("no route")
    fused = rrf(hits, rrf_k, k) if method == "rrf" else weighted(hits, weights or {}, k)
    return above(fused, threshold) if threshold is not None else fused


def cascade(queries: DataFrame, routes: list[Route], k: int = 10) -> DataFrame:
    """The first route's hits; queries that it has no hit for are answered by the next one, and so on."""
    found, left = None, cut(queries, "queries")
    for run in routes:
        hits = cut(run(left, k), "hits")
        found = hits if found is None else found.unionByName(hits)
        left = cut(left.join(hits.select("query_id").distinct(), "query_id", "left_anti"), "queries")
        if left.isEmpty():
            break
    return found


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits of at least that score."""
    return hits.filter(F.col("score") >= threshold)


def counts(hits: DataFrame) -> DataFrame:
    """(query_id, strategy, hits)"""
    return hits.groupBy("query_id", "strategy").agg(F.count("*").alias("hits"))
