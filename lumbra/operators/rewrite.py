"""Query rewriting: one query becomes several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.functions.generate import Generate, generated
from lumbra.operators.sizes import small


def synonyms(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, ord, query): the query, then for each of its words and each synonym the query with all occurrences replaced. Words are exact."""
    words = queries.select("query_id", "query", F.posexplode(X.fields(F.col("query"))).alias("pos", "word"))
    variants = words.join(small(table.select("word", "synonym")), "word")
    variants = variants.select("query_id", "pos", "synonym", F.replace(F.col("query"), F.col("word"), F.col("synonym")).alias("query"))
    all_of = queries.select("query_id", F.lit(-1).alias("pos"), F.lit("").alias("synonym"), "query").unionByName(variants)
    lists = all_of.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "synonym", "query"))).alias("x"))
    return lists.select("query_id", F.posexplode(F.transform("x", lambda x: x["query"])).alias("ord", "query"))


def hyde(queries: DataFrame, generate: Generate) -> DataFrame:
    """(query_id, ord, query): the query and a made-up document that would answer it."""
    made = queries.select("query_id", "query", generated(F.col("query"), generate).alias("made"))
    return made.select("query_id", F.posexplode(F.array("query", "made")).alias("ord", "query"))


def multi_query(queries: DataFrame, generate: Generate, n: int = 3) -> DataFrame:
    """(query_id, ord, query): the query and up to n others from the lines of an answer; blank lines and echoes are dropped."""
    made = queries.select("query_id", "query", generated(F.col("query"), generate).alias("made"))
    lines = F.filter(F.transform(F.split("made", "\n"), X.trim), lambda x: (x != "") & (x != X.trim(F.col("query"))))
    return made.select("query_id", F.posexplode(F.concat(F.array("query"), F.slice(lines, 1, n))).alias("ord", "query"))


def composite(queries: DataFrame, rewriters: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, list[Exception]]:
    """Each rewriter works on all that the one before gave; one that fails keeps its input and is reported. Duplicates stay."""
    errors: list[Exception] = []
    for rewrite in rewriters:
        try:
            step = queries.withColumn("query_id", F.struct("query_id", F.monotonically_increasing_id().alias("n")))
            queries = rewrite(step).select(F.col("query_id.query_id").alias("query_id"), "query")
            queries.schema  # noqa: B018
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    return queries, errors
