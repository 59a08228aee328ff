"""Files as tables: scan, parse, elements and texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.sources import parsers
from lumbra.sources import pdf as pdf_pages

_FILE = "source string, title string, doc_type string, content string, metadata map<string,string>, error string"
_ELEMENT = "source string, ord int, page int, section_path array<string>, type string, level int, text string, language string, ordered boolean, items array<string>, headers array<string>, rows array<array<string>>"


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(source, modified, size, data) of the supported files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").alias("data"))
    return rows.filter(X.extension(F.col("source")).isin(*(extensions or sorted(parsers.TYPE_OF))))


def blocks(files: DataFrame, size: int = 4096) -> DataFrame:
    """(source, block, data): the files' bytes in blocks of that size, the last one shorter; an empty file has none."""
    n = F.ceil(F.octet_length("data") / size).cast("int")
    rows = files.filter(F.octet_length("data") > 0).select("source", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return rows.select("source", "block", F.substring(F.col("data"), F.col("block") * size + 1, F.lit(size)).alias("data"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source, content) of whole text files."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for source, data in zip(b["source"], b["data"], strict=True):
            p = parsers.parse(bytes(data), source, as_document=True)
            body = None if p.error else "\n\n".join(filter(None, map(parsers.render, p.elements)))
            rows.append((source, p.title, parsers.TYPE_OF.get(parsers.extension(source), "txt"), body, p.metadata, p.error))
        yield pd.DataFrame(rows, columns=["source", "title", "doc_type", "content", "metadata", "error"])


def documents(files: DataFrame) -> DataFrame:
    """One row for each file: title, type, the text of its elements, metadata, or the error that stopped its parser. files: source, data."""
    return files.select("source", "data").mapInPandas(_documents, _FILE)


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for source, data in zip(b["source"], b["data"], strict=True):
            for i, e in enumerate(parsers.parse(bytes(data), source).elements):
                rows.append((source, i, e.page, list(e.section), e.type, e.level, e.text or None, e.language, e.ordered, e.items, e.headers, e.rows))
        names = [c.split()[0] for c in _ELEMENT.split(", ")]
        yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def elements(files: DataFrame) -> DataFrame:
    """The elements of each file in reading order."""
    return files.select("source", "data").mapInPandas(_elements, _ELEMENT)


def render(elements: DataFrame, key: str = "source") -> DataFrame:
    """(key, content): the elements' texts in order with blank lines between them."""
    marks = F.transform("items", lambda x, i: F.when(F.coalesce("ordered", F.lit(False)), F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("- "), x)))
    lines = F.transform(F.concat(F.when(F.size("headers") > 0, F.array("headers")).otherwise(F.array().cast("array<array<string>>")), F.coalesce("rows", F.array().cast("array<array<string>>"))), lambda r: F.array_join(r, " | "))
    body = (
        F.when(F.col("type") == "table", F.array_join(lines, "\n")).when(F.col("type") == "list", F.array_join(marks, "\n"))
        .when(F.col("type") == "image", F.concat(F.lit("[Image: "), F.coalesce("text", F.lit("")), F.lit("]"))).when(F.col("type") == "separator", F.lit("---")).otherwise(F.coalesce("text", F.lit("")))
    )
    rows = elements.select(key, F.struct("ord", body.alias("body")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select(key, F.array_join(F.filter(F.transform("x", lambda e: e["body"]), lambda t: t != ""), "\n\n").alias("content"))


def counts(elements: DataFrame, key: str = "source") -> DataFrame:
    """(key, paragraphs, tables, images, words): headings count as paragraphs."""
    t = F.col("type")
    return elements.groupBy(key).agg(
        F.count_if(t.isin("paragraph", "heading")).alias("paragraphs"),
        F.count_if(t == "table").alias("tables"),
        F.count_if(t == "image").alias("images"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), X.word_count(F.col("text")))), F.lit(0)).alias("words"),
    )


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"source": b["source"], "data": [parsers.write_docx((t or "").split("\n")) for t in b["content"]]})


def to_docx(texts: DataFrame) -> DataFrame:
    """(source, data): each text (source, content) as a Word file with a paragraph for each line."""
    return texts.select("source", "content").mapInPandas(_docx, "source string, data binary")


def _pdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"source": b["source"], "data": [pdf_pages.write((t or "").split("\f")) for t in b["content"]]})


def to_pdf(texts: DataFrame) -> DataFrame:
    """(source, data): each text (source, content) as a PDF with a page for each part between form feeds."""
    return texts.select("source", "content").mapInPandas(_pdf, "source string, data binary")


_WRITERS = {"docx": lambda t: parsers.write_docx(t.split("\n")), "pdf": lambda t: pdf_pages.write(t.split("\f"))}


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kinds = [parsers.TYPE_OF.get(parsers.extension(s), "txt") for s in b["source"]]
        yield pd.DataFrame({"source": b["source"], "data": [_WRITERS.get(k, str.encode)(t or "") for k, t in zip(kinds, b["content"], strict=True)]})


def write(texts: DataFrame) -> DataFrame:
    """(source, data): each text (source, content) as a file of the type that its name tells; all but Word files and PDFs are the text itself."""
    return texts.select("source", "content").mapInPandas(_written, "source string, data binary")


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
