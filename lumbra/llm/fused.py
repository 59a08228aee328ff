"""Problem 7: one ranking from scores on different scales, by robust rank aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbra.llm.common import join_hot, running_total
from lumbra.session import cut


def counted(results: DataFrame, options: DataFrame) -> DataFrame:
    """(query_id, strategy, id, score, weight): the latest row of each, of routes that count.

    A route's weight of zero or below or without end, a null or NaN score and null ids don't count; an absent weight is the mean of the
    profile's positive ones, or 1. Equal retrieved_at: the larger score. hybrid_options is a fixed table of some profiles and is broadcast.
    """
    row = F.max(F.struct("retrieved_at", "score", "profile")).alias("row")
    latest = results.filter("query_id is not null and id is not null and strategy is not null").groupBy("query_id", "strategy", "id").agg(row)
    latest = latest.select("query_id", "strategy", "id", F.col("row.score").alias("score"), F.col("row.profile").alias("profile"))
    opts = options.groupBy("profile").agg(F.max(F.struct(F.map_entries("weights").alias("w"))).alias("o")).select("profile", F.map_from_entries("o.w").alias("weights"))
    positive = F.filter(F.map_values("weights"), lambda x: (x > 0) & (x < math.inf))
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda s, x: s + x) / F.size(positive))
    met = latest.filter("score is not null and not isnan(score)").join(F.broadcast(opts.withColumn("mean", mean)), "profile", "left")
    weight = F.coalesce(F.try_element_at("weights", F.col("strategy")), F.col("mean"), F.lit(1.0))
    return met.select("query_id", "strategy", "id", "score", weight.alias("weight")).filter((F.col("weight") > 0) & (F.col("weight") < math.inf))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds n (the route's items for the query), better (items with a higher score) and ties (items with this score).

    Ranks come from counts of distinct scores and a prefix sum over ranges, so that no query has to fit into a task.
    """
    group = ["query_id", "strategy"]
    counts = rows.groupBy(*group, "score").agg(F.count("*").alias("ties"))
    upto = cut(running_total(counts, group, [F.col("score").desc()], "ties", "upto"), "ranks")
    total = upto.groupBy(*group).agg(F.sum("ties").alias("n"))
    upto = upto.join(total, group).withColumn("better", F.col("upto") - F.col("ties"))
    return join_hot(rows, upto, [*group, "score"], "ties", rows.count())


def log_beta_tail(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln I_r(a, b), the regularised incomplete beta function, for 0 < r <= 1 and real a, b > 0.

    For whole numbers it is the probability that the a-th smallest of a + b - 1 uniform ranks lies at or below r. A continued fraction on
    the side where it converges fast; logarithms, so that a hundred first ranks don't run into zero.
    """
    r, a, b = (np.asarray(x, float) for x in (r, a, b))
    far = r > (a + 1) / (a + b + 2)
    x, p, q = np.where(far, 1 - r, r), np.where(far, b, a), np.where(far, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = gamma(p + q) - gamma(p) - gamma(q) + p * np.log(x) + np.where(q == 0, 0, q * np.log1p(-x)) - np.log(p)
        c = np.ones_like(x)
        d = 1 - (p + q) * x / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        # steps needed grow with the square root of the larger parameter
        for m in range(1, 200 + int(4 * math.sqrt(float(max(p.max(initial=1), q.max(initial=1)))))):
            t = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            t = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if not len(h) or np.abs(d * c - 1).max() < 1e-14:
                break
        near = front + np.log(h)
        out = np.where(far, np.log1p(-np.exp(np.minimum(near, 0))), near)
    return np.where(r >= 1, 0.0, np.minimum(out, 0.0))


@F.pandas_udf(T.DoubleType())
def _least(ranks: pd.Series, weights: pd.Series, routes: pd.Series) -> pd.Series:
    """ln of the least tail probability over an item's own ranks; weights are brought to a mean of 1, and all of them sum to routes."""
    size = np.fromiter(map(len, ranks), int, len(ranks))
    if not len(size):
        return pd.Series([], dtype=float)
    row = np.repeat(np.arange(len(size)), size)
    r, w = np.concatenate(ranks.to_list()), np.concatenate(weights.to_list())
    order = np.lexsort((r, row))
    r, w = r[order], w[order]
    upto = np.cumsum(w)
    start = np.r_[0, np.cumsum(size)[:-1]]
    upto -= (upto[start] - w[start])[row]
    # equal ranks count together: the last of them has the whole sum
    last = np.r_[(row[1:] != row[:-1]) | (r[1:] != r[:-1]), True]
    n = routes.to_numpy(float)[row]
    a = np.minimum(upto, n)
    out = np.full(len(size), 0.0)
    np.minimum.at(out, row[last], log_beta_tail(r[last], a[last], (n - a)[last] + 1))
    return pd.Series(out)


def aggregated(rows: DataFrame) -> DataFrame:
    """(query_id, id, log_p, significance, mean_rank, firsts, routes) for each item that a counted route has scored.

    A rank is (rank - 1/2) / n with the mean rank of ties; where a route doesn't have the item it is 1. Each route is one list. For each of
    the item's ranks r, sorted, p(r) is the probability that the order statistic with so many lists at or below r lies there by chance: the beta
    distribution with a = the weight of these lists, weights having the mean 1, and b = lists - a + 1. Equal weights give the whole numbers
    of the unweighted statistic. log_p is the least ln p(r); significance is p times the number of lists, at most 1.
    """
    r = cut(ranked(rows), "ranked")
    lists = r.groupBy("query_id", "strategy").agg(F.max("weight").alias("weight")).groupBy("query_id").agg(F.sum("weight").alias("sum"), F.count("*").cast("int").alias("routes"))
    value = (F.col("better") + F.col("ties") / 2.0) / F.col("n")
    first = F.when((F.col("better") == 0) & (F.col("ties") == 1), 1).otherwise(0)
    items = r.groupBy("query_id", "id").agg(F.collect_list(F.struct(value.alias("r"), "weight")).alias("ranks"), F.sum(first).alias("firsts"))
    # a query has one line of lists; there are as many lines as queries, and the items of one query may be many
    items = cut(items, "items")
    sizes = items.groupBy("query_id").agg(F.count("*").alias("items"))
    met = join_hot(items, lists.join(sizes, "query_id"), ["query_id"], "items", items.count())
    met = met.withColumn("unit", F.transform("ranks", lambda x: x["weight"] / F.col("sum") * F.col("routes")))
    met = met.withColumn("log_p", _least(F.col("ranks.r"), F.col("unit"), F.col("routes")))
    here = F.aggregate(F.zip_with("ranks", "unit", lambda x, u: x["r"] * u), F.lit(0.0), lambda s, x: s + x)
    have = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    met = met.withColumn("mean_rank", (here + F.col("routes") - have) / F.col("routes"))
    return met.select("query_id", "id", "log_p", F.least(F.lit(1.0), F.exp("log_p") * F.col("routes")).alias("significance"), "mean_rank", "firsts", "routes")


def ranking(results: DataFrame, options: DataFrame) -> DataFrame:
    """(query_id, id, rank, significance): every query's items in order of significance, then mean rank, then id."""
    items = aggregated(cut(counted(results, options), "counted")).withColumn("one", F.lit(1))
    order = [F.round("log_p", 9), F.round("mean_rank", 9), F.col("id")]
    placed = running_total(items, ["query_id"], order, "one", "rank")
    return placed.select("query_id", "id", "rank", "significance")


def leaders(results: DataFrame, options: DataFrame) -> DataFrame:
    """(query_id, id): the first item of each query's ranking, where it alone leads every counted route and at least two count."""
    items = aggregated(cut(counted(results, options), "counted"))
    top = items.groupBy("query_id").agg(F.min(F.struct(F.round("log_p", 9), F.round("mean_rank", 9), "id", "firsts", "routes")).alias("x")).select("query_id", "x.*")
    return top.filter("routes > 1 and firsts = routes").select("query_id", "id")
