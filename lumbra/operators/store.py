"""Document and chunk tables: create, get, update, delete, list. A change is a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.schema import DOC_TYPES, STATUSES


def create(docs: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with version 1; ids that are there already fail the query."""
    clash = new.join(docs.select(F.col("id").alias("_have")), F.col("id") == F.col("_have"), "left")
    ok = F.when(F.col("_have").isNull(), F.lit(1)).otherwise(F.raise_error(F.concat(F.lit("document exists: "), "id")).cast("int"))
    return docs.unionByName(clash.withColumn("version", ok).drop("_have"), allowMissingColumns=True)


def get(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_semi")


def update(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of changed in place of those with their ids, one version higher; ids that aren't there are ignored."""
    old = docs.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    new = changed.join(old, F.col("id") == F.col("_id")).withColumn("version", F.col("_version") + 1).drop("_id", "_version")
    return docs.join(changed.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


def page(docs: DataFrame, limit: int = 10, offset: int = 0, id_col: str = "id") -> DataFrame:
    """Newest first, ties by id; without a positive limit all rows. Nulls come last."""
    rows = docs.orderBy(F.col("created_at").desc_nulls_last(), id_col)
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit > 0 else rows


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.filter(F.col("document_id") == document_id).orderBy("chunk_index", "id")


def add_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    return chunks.unionByName(new, allowMissingColumns=True)


def delete_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Without the chunks of the documents, told by document_id."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def checked(docs: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with a row's id, content, type or status."""
    wrong = [
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", F.lit("no id")),
        F.when(F.coalesce("content", F.lit("")) == "", F.lit("no content")),
        F.when(~F.coalesce(F.col("doc_type").isin(*DOC_TYPES), F.lit(False)), F.lit("unknown type")),
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("unknown status")),
    ]
    return docs.withColumn("problems", F.array_compact(F.array(*wrong)))


def enriched(results: DataFrame, docs: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Results with columns of their documents; a missing document gives nulls."""
    return results.join(docs.select(F.col(id_col).alias("id"), *columns), "id", "left")
