"""Rerankers over candidates (query_id, id, score, content), a few for each query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.operators.keyword import top

SCORE, MATCH = 0.3, 0.7


def match_score(query: Column, content: Column) -> Column:
    """Share of the query's words, with repetition, that the content has; 0 for a query without words."""
    q, c = X.space_tokens(query), X.space_tokens(content)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.filter(q, lambda w: F.array_contains(c, w))) / F.size(q))


def match(candidates: DataFrame, queries: DataFrame, keep: int | None = None) -> DataFrame:
    """Adds rerank_score = 0.3 score + 0.7 match, ranked by it."""
    rows = candidates.drop("rank").join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("rerank_score", SCORE * F.col("score") + MATCH * match_score(F.col("query"), F.col("content"))).drop("query")
    return top(rows, keep, "rerank_score")


def pseudo_jaccard(a: Column, b: Column) -> Column:
    """Words of b, with repetition, that are in a, over the distinct words of a plus all of b less these. Not symmetric."""
    x, y = F.array_distinct(X.space_tokens(a)), X.space_tokens(b)
    both = F.size(F.filter(y, lambda w: F.array_contains(x, w)))
    whole = F.size(x) + F.size(y) - both
    return F.when(whole == 0, F.lit(0.0)).otherwise(both / whole)


def _similar(a: list[str], b: list[str]) -> float:
    x = set(a)
    both = sum(w in x for w in b)
    whole = len(x) + len(b) - both
    return both / whole if whole else 0.0


def mmr(candidates: DataFrame, keep: int = 10, trade: float = 0.5, first_wins: bool = False) -> DataFrame:
    """Adds rank: each next item is the one with the largest trade * score - (1 - trade) * similarity to what was chosen; ties by order of score and id.

    A trade outside of (0, 1] is 0.5. With first_wins a round in which no item is above 0 takes the first that is left. Similarities lie between 0 and 1,
    so an item whose score is less than the keep-th best by more than (1 - trade) / trade is never chosen, and leaves before the choice.
    """
    trade = trade if 0 < trade <= 1 else 0.5
    ranked = top(candidates.drop("rank"), None)
    least = ranked.filter(F.col("rank") <= keep).groupBy("query_id").agg((F.min("score") - (1 - trade) / trade - 1e-6).alias("_least"))
    ranked = ranked.join(least, "query_id").filter(F.col("score") >= F.col("_least"))
    rows = ranked.select("query_id", "id", "score", "content", F.col("rank").alias("ord"), X.space_tokens(F.col("content")).alias("words"))

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        words, score = [list(w) for w in group["words"]], group["score"].to_numpy()
        left, worst, order = list(range(len(group))), [0.0] * len(group), []
        while left and len(order) < keep:
            value = {i: trade * score[i] - (1 - trade) * worst[i] for i in left}
            best = max(left, key=lambda i: (value[i], -i))
            if first_wins and value[best] <= 0:
                best = left[0]
            order.append(best)
            left.remove(best)
            for i in left:
                worst[i] = max(worst[i], _similar(words[i], words[best]))
        out = group.loc[order, ["query_id", "id", "score", "content"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    kinds = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, content string, rank int")


def pipeline(candidates: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rerankers one after the other."""
    for step in steps:
        candidates = step(candidates)
    return candidates
