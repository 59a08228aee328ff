"""Context, prompts and answers from ranked results (query_id, rank, content, source, score)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.functions import text as X


@dataclass(frozen=True)
class Template:
    """Formats with {index}, {content}, {source}, {score} and {question}."""

    system: str = "Answer the question from the references below. If they don't hold the answer, say so."
    context: str = "Reference {index}:\n{content}\nSource: {source}"
    question: str = "Question: {question}"
    empty: str = "No reference answers this question."


def _ordered(results: DataFrame, line: Column, glue: str) -> DataFrame:
    """One string for each query: its lines in order of rank. A query has as many results as the search's k."""
    rows = results.select("query_id", F.struct("rank", line.alias("line")).alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["line"]), glue).alias("joined"))


def context(results: DataFrame) -> DataFrame:
    """(query_id, context): '[n] content' for each result, its source below if it has one."""
    src = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("source: "), "source", F.lit("\n"))).otherwise("")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("content", F.lit("")), F.lit("\n"), src, F.lit("\n"))
    return _ordered(results, line, "").withColumnRenamed("joined", "context")


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def prompt(queries: DataFrame, results: DataFrame, template: Template = Template()) -> DataFrame:
    """(query_id, prompt): system text, references, question. A query without results has no references."""
    line = _fill(template.context, index=F.col("rank").cast("string"), source=F.coalesce("source", F.lit("")), score=F.format_string("%.4f", F.col("score")), content=F.coalesce("content", F.lit("")))
    refs = _ordered(results, line, "\n\n")
    head = F.when(F.col("joined").isNull(), F.lit("")).otherwise(F.concat(F.lit("=== References ===\n"), "joined", F.lit("\n\n")))
    body = F.concat(F.lit(template.system + "\n\n"), head, F.lit("=== Question ===\n"), _fill(template.question, question=F.col("query")), F.lit("\n\n=== Answer ===\n"))
    return queries.join(refs, "query_id", "left").select("query_id", body.alias("prompt"))


def fallback_answer(queries: DataFrame, results: DataFrame, most: int = 300) -> DataFrame:
    """(query_id, answer) without a model: the numbered results, cut at most characters, with source and score."""
    name = F.when(F.coalesce("source", F.lit("")) == "", F.concat(F.lit("source "), F.col("rank").cast("string"))).otherwise(F.col("source"))
    score = F.when(F.col("score") > 0, F.format_string(" (score %.2f)", F.col("score"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), name, score, F.lit("\n   "), X.truncate(F.col("content"), most))
    found = _ordered(results, line, "\n\n").join(results.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    text = F.concat(F.format_string("%d results:\n\n", F.col("n")), "joined")
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce(text, F.lit("Nothing in the knowledge base answers this question.")).alias("answer"))
