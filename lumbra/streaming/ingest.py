"""Incremental ingest: a stream of files or rows becomes versioned document tables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumbra.functions import text as X
from lumbra.sources import files


def watch(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """A stream of new and changed files under a folder: source, modified, size, data."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").alias("data"))
    return rows.filter(X.extension(F.col("source")).isin(*extensions)) if extensions else rows


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(source, event) between two snapshots (source, modified): create, modify or delete. A renamed file is deleted and created."""
    a, b = before.select("source", F.col("modified").alias("m1")), now.select("source", F.col("modified").alias("m2"))
    event = F.when(F.col("m1").isNull(), "create").when(F.col("m2").isNull(), "delete").when(F.col("m1") != F.col("m2"), "modify")
    return a.join(b, "source", "full").select("source", event.alias("event")).filter("event is not null")


def latest(versions: DataFrame, key: str = "source", order: str = "batch") -> DataFrame:
    """The current rows of a table that only grows: of each key the row of the last batch."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), order).alias("row")).select("row.*")


def start(stream: DataFrame, folder: str, prepare: Callable[[DataFrame], DataFrame] = files.documents, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Append each batch, prepared, to the table at folder with its batch number. A batch that is written again replaces itself, so a restart doubles nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        prepare(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number:012d}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or f"{folder}-checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All batches that start() has written."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def batch_report(parsed: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed. The errors themselves are in batch_errors."""
    return parsed.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def batch_errors(parsed: DataFrame) -> DataFrame:
    """(source, error) of every file that couldn't be parsed."""
    return parsed.filter("error is not null").select("source", "error")
