"""Retrieval metrics. run (query_id, rank, doc_id), qrels (query_id, doc_id, relevance > 0 counts as relevant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)
# Thresholds of the quality gate.
GATE = {"recall_1": 0.3, "recall_5": 0.5, "recall_10": 0.7, "precision_5": 0.4, "mrr": 0.4, "map": 0.4, "ndcg_10": 0.5}


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, failed: DataFrame | None = None) -> DataFrame:
    """query_id, retrieved, relevant, recall_k, precision_k, ndcg_k of each k, mrr and map, for every query of qrels that hasn't failed.

    Precision is over min(k, retrieved), 0 if nothing was; a document that comes twice counts twice. The ideal gain is over as many
    as min(k, retrieved) best relevances. A query without relevant documents has zeros. map divides by the number of relevant ones.
    """
    rel = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("rel"))
    queries = qrels.select("query_id").distinct()
    if failed is not None:
        queries = queries.join(failed.select("query_id"), "query_id", "left_anti")
    hits = run.join(rel, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0))).withColumn("hit", (F.col("rel") > 0).cast("int"))
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("so_far", so_far)
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    sums = [F.count("*").alias("retrieved"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap")]
    for k in ks:
        near = F.col("rank") <= k
        sums += [F.sum(F.when(near, F.col("hit")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(near, gain).otherwise(0.0)).alias(f"dcg{k}")]
    got = hits.groupBy("query_id").agg(*sums)
    some = rel.filter("rel > 0")
    # only the best few of a query's relevances are kept, so each task drops the others before the shuffle
    best = some.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))).filter(F.col("n") <= max(ks))
    ideal = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "rel"))).alias("gains"))
    number = some.groupBy("query_id").agg(F.count("*").alias("relevant"))
    m = queries.join(got, "query_id", "left").join(number, "query_id", "left").join(ideal, "query_id", "left").fillna(0, ["retrieved", "relevant"])
    cols = ["query_id", F.col("retrieved").cast("long"), F.col("relevant").cast("long")]
    zero = F.lit(0.0)
    gains = F.coalesce("gains", F.array().cast("array<struct<n:int,rel:double>>"))

    def ideal_gain(used: Column) -> Column:
        return F.aggregate(F.filter(gains, lambda g: g["n"] <= used), zero, lambda s, g: s + g["rel"] / F.log2(g["n"] + 1))

    for k in ks:
        used = F.least(F.lit(k), "retrieved")
        idcg = ideal_gain(used)
        cols += [
            F.when(F.col("relevant") > 0, F.coalesce(f"h{k}", F.lit(0)) / F.col("relevant")).otherwise(zero).alias(f"recall_{k}"),
            F.when((F.col("retrieved") > 0) & (F.lit(k) > 0), F.coalesce(f"h{k}", F.lit(0)) / used).otherwise(zero).alias(f"precision_{k}"),
            F.when(idcg > 0, F.col(f"dcg{k}") / idcg).otherwise(zero).alias(f"ndcg_{k}"),
        ]
    cols += [F.coalesce(1 / F.col("first"), zero).alias("mrr"), F.when(F.col("relevant") > 0, F.coalesce("ap", zero) / F.col("relevant")).otherwise(zero).alias("map")]
    return m.select(*cols)


def mean(metrics: DataFrame) -> DataFrame:
    """One row: the mean of each metric over the queries, and their number."""
    names = [c for c in metrics.columns if c not in ("query_id", "retrieved", "relevant")]
    return metrics.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def gate(means: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, threshold, passed) of each threshold."""
    t = GATE if thresholds is None else thresholds
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(x)).alias("threshold"), (F.col(m) >= x).alias("passed")) for m, x in t.items()])).alias("x")
    return means.select(rows).select("x.*")


def verdict(checked: DataFrame) -> DataFrame:
    """One row: passed, score (the mean value), warnings."""
    warn = F.format_string("%s %.4f is below %.4f", "metric", "value", "threshold")
    return checked.agg(F.min("passed").alias("passed"), F.avg("value").alias("score"), F.sort_array(F.collect_list(F.when(~F.col("passed"), warn))).alias("warnings"))


def report(means: DataFrame) -> DataFrame:
    """One row with the metrics as JSON and as lines of text."""
    names = [c for c in means.columns if c != "queries"]
    lines = F.concat_ws("\n", *[F.format_string(f"{c}: %.4f", F.col(c)) for c in names])
    return means.select(F.to_json(F.struct(*means.columns)).alias("json"), lines.alias("text"))
