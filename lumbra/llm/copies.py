"""Problem 3: records that differ only in white space, letter case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.llm.common import join_hot
from lumbra.session import cut

#: A "Key: value" line; the key is words without other signs, however many.
FIELD = r"(?s)^\s*[\p{L}\p{N}][\p{L}\p{N}_ \t-]*[:\uFF1A](?:\s.*)?$"


def canonical(content: Column) -> Column:
    """Letters, digits and combining marks of the content in folded case, the fields of a record in sorted order; null stays null.

    A record is a JSON value with objects (fields sorted on every level; keys folded first) or a text of two or more
    lines that are all "Key: value". Anything else keeps its order. A broken JSON text counts as prose.
    """
    folded = F.replace(F.replace(F.lower(F.upper(content)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"[^\p{L}\p{N}\p{M}]+", "")

    parsed = F.when(folded.rlike(r"(?s)^\s*[\{\[].*[\}\]]\s*$"), F.to_json(F.try_parse_json(folded)))
    lines = F.filter(F.split(folded, r"[\r\n]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    maybe = content.rlike(r"^\s*[\p{L}\p{N}][^\r\n:\uFF1A]*[:\uFF1A]")
    record = F.when(maybe & (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(FIELD)), F.array_join(F.array_sort(F.transform(lines, bare)), ""))
    return F.coalesce(record, bare(F.coalesce(parsed, folded)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, h1, h2, check): 128 bits of the canonical content in two halves, and another hash with the length to tell collisions apart.

    Rows without an id are left out. All three are null for a content without any letter or digit, which has no copies by definition.
    """
    c = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), canonical(F.col(content)).alias("c"))
    c = c.select("doc_id", F.when(F.col("c").rlike(r"[\p{L}\p{N}]"), F.col("c")).alias("c"))
    digest = F.unhex(F.md5("c"))
    half = [F.conv(F.hex(F.substring(digest, i, 8)), 16, -10).cast("long") for i in (1, 9)]
    return c.select("doc_id", half[0].alias("h1"), half[1].alias("h2"), F.when(F.col("c").isNotNull(), F.xxhash64("c", F.length("c"))).alias("check"))


KEY = ("h1", "h2", "check")


def groups(prints: DataFrame) -> DataFrame:
    """One line for each distinct canonical content with first_doc_id and copies. Counts are combined before the shuffle.

    Contents that agree in the 128 bits but not in the check are different groups: a collision never merges records.
    """
    return prints.filter("h1 is not null").groupBy(*KEY).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))


def collisions(prints: DataFrame) -> DataFrame:
    """(h1, h2, contents, copies): fingerprints that several different contents have, as the other hash and the length tell; empty if the 128 bits are enough."""
    by_check = prints.filter("h1 is not null").groupBy(*KEY).agg(F.count("*").alias("copies"))
    return by_check.groupBy("h1", "h2").agg(F.count("*").alias("contents"), F.sum("copies").alias("copies")).filter("contents > 1")


def collapse(docs: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, copies): one row for each set of copies, under its smallest id, and how many there are.

    A document whose content is null, empty or without a letter or digit stands for itself with copies = 1.
    """
    prints = fingerprints(docs, id_col, content)
    alone = F.when(F.col("h1").isNull(), F.col("doc_id"))
    return prints.groupBy(*KEY, alone.alias("alone")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def copies(docs: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(first_doc_id, doc_id): the smallest id of each set of copies with every other one. An empty table gives no row.

    Fingerprints are written once; sets that hold more than a thousandth of all rows are joined by broadcast.
    """
    prints = cut(fingerprints(docs, id_col, content).filter("h1 is not null"), "prints")
    found = cut(groups(prints).filter("copies > 1"), "copies")
    return join_hot(prints, found, KEY, "copies", prints.count()).filter("doc_id <> first_doc_id").select("first_doc_id", "doc_id").distinct()
