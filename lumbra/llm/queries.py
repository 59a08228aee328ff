"""The pN_ queries and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.llm import copies, distinctive, fused, garbled, knn, markup, mixing, names, near, packing


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.pairs(_table(spark, sf, "entities"))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.linked(_table(spark, sf, "entities"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(_table(spark, sf, "documents")).filter("kinds <> ''").select("doc_id")


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(_table(spark, sf, "documents"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copies(_table(spark, sf, "documents"))


def p3_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapse(_table(spark, sf, "documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return knn.mutual(_table(spark, sf, "vectors"))


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n = knn.neighbours(_table(spark, sf, "vectors"))
    return n.select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.found(_table(spark, sf, "documents"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near.grouped(_table(spark, sf, "documents"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = distinctive.records(_table(spark, sf, "chunks"), "chunks", "id")
    return chunks.unionByName(distinctive.records(_table(spark, sf, "tsvector_index"), "tsvector_index", "doc_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    keep = distinctive.Keep(min_tf=3, min_df=2, max_df=8, min_length=5, han=False)
    return distinctive.scores(_records(spark, sf), keep).filter("score > 0").select("table_name", "record_id", "term")


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.scores(_records(spark, sf)).select("table_name", "record_id", "term", "tf", "df", F.round("score", 6).alias("score"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return fused.leaders(_table(spark, sf, "retrieval_results"), _table(spark, sf, "hybrid_options"))


def p7_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fused.ranking(_table(spark, sf, "retrieval_results"), _table(spark, sf, "hybrid_options"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_table(spark, sf, "documents"), _table(spark, sf, "context_budgets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    budgets = _table(spark, sf, "context_budgets")
    return packing.report(packing.packed(_table(spark, sf, "documents"), budgets), budgets)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf, "documents"), _table(spark, sf, "source_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = _table(spark, sf, "source_targets")
    return mixing.shares(mixing.mixture(_table(spark, sf, "documents"), targets), targets)


def p9_sized(spark: SparkSession, sf: str) -> DataFrame:
    """Half of what the named sources have; those that can't reach their share of it give all they have at their cap."""
    return mixing.mixture(_table(spark, sf, "documents"), _table(spark, sf, "source_targets"), part=0.5)


def p9_sized_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_sized(spark, sf), _table(spark, sf, "source_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.repaired(_table(spark, sf, "documents")).filter("places > 0").select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.repaired(_table(spark, sf, "documents")).filter("places > 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1:].split("_")[0]), x[0])))
