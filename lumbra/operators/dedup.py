"""Exact duplicates by content hash, and the hash index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions import hashing


def fast_hash(content: Column) -> Column:
    """SHA-256 in the JVM: groups as SM3 does, without Python."""
    return F.sha2(content, 256)


def mark(docs: DataFrame, id_col: str = "id", content: str = "content", order: str = "created_at", sm3: bool = False, enabled: bool = True) -> DataFrame:
    """(id, hash, content_size, is_duplicate, existing_id): the first of equal contents in order stays, the others point to it.

    Empty and null contents are not checked. The first of each hash is found by aggregation, so no group of copies is sorted in a task;
    ties in order go to the smaller id. Disabled, only hashes are made.
    """
    h = hashing.sm3(F.col(content)) if sm3 else fast_hash(F.col(content))
    rows = docs.select(F.col(id_col).alias("id"), h.alias("hash"), F.octet_length(content).cast("long").alias("content_size"), F.col(order).alias("_order"))
    if not enabled:
        return rows.select("id", "hash", "content_size", F.lit(False).alias("is_duplicate"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("existing_id"))
    some = rows.filter("content_size > 0")
    first = some.groupBy("hash").agg(F.min(F.struct("_order", "id")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("hash", F.col("f.id").alias("existing_id"))
    met = rows.join(first, "hash", "left")
    dup = F.coalesce((F.col("content_size") > 0) & (F.col("existing_id") != F.col("id")), F.lit(False))
    return met.select("id", "hash", "content_size", dup.alias("is_duplicate"), F.when(dup, F.col("existing_id")).alias("existing_id"))


def hash_index(docs: DataFrame, id_col: str = "id", content: str = "content", source: str = "source", order: str = "created_at") -> DataFrame:
    """(hash, document_id, content_size, created_at, source) of the first document of each content; derived from live rows, so a deleted document leaves nothing."""
    rows = docs.filter(F.length(content) > 0).select(fast_hash(F.col(content)).alias("hash"), F.struct(F.col(order).alias("created_at"), F.col(id_col).alias("document_id"), F.octet_length(content).cast("long").alias("content_size"), F.col(source).alias("source")).alias("x"))
    return rows.groupBy("hash").agg(F.min("x").alias("x")).select("hash", "x.document_id", "x.content_size", "x.created_at", "x.source")


def lookup(index: DataFrame, hashes: DataFrame) -> DataFrame:
    return index.join(hashes.select("hash").distinct(), "hash", "left_semi")


def put(index: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by hash; of several new rows of a hash the latest counts."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy(F.col("created_at").desc(), "document_id"))).filter("_n = 1").drop("_n")
    return index.join(last.select("hash"), "hash", "left_anti").unionByName(last)


def remove(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.join(documents.select("document_id"), "document_id", "left_anti")


def stats(marked: DataFrame) -> DataFrame:
    """One row: documents, distinct contents, duplicates, bytes and bytes in duplicates."""
    dup = F.col("is_duplicate").cast("int")
    return marked.agg(F.count("*").alias("documents"), F.count_distinct("hash").alias("hashes"), F.coalesce(F.sum(dup), F.lit(0)).alias("duplicates"), F.sum("content_size").alias("bytes"), F.coalesce(F.sum(F.when(dup == 1, F.col("content_size"))), F.lit(0)).alias("duplicate_bytes"))


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(source, modified, hash): the hash of each file (source, modified, data), from the cache (source, modified, hash) where the file hasn't changed since; the others are read and hashed."""
    known = cache.groupBy("source", "modified").agg(F.min("hash").alias("hash"))
    kept = files.select("source", "modified").join(known, ["source", "modified"])
    new = files.join(known, ["source", "modified"], "left_anti").select("source", "modified", F.sha2("data", 256).alias("hash"))
    return kept.unionByName(new)


def files(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, hash, content_size, is_duplicate, existing_path) of the files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = rows.select("path", "modificationTime", hashing.sm3_binary(F.col("content")).alias("hash"), F.col("length").alias("content_size"))
    first = rows.groupBy("hash").agg(F.min(F.struct("modificationTime", "path")).alias("f")).select("hash", F.col("f.path").alias("first"))
    met = rows.join(first, "hash")
    return met.select("path", "hash", "content_size", (F.col("path") != F.col("first")).alias("is_duplicate"), F.when(F.col("path") != F.col("first"), F.col("first")).alias("existing_path"))
