"""Chunkers: one row for each piece of a text, with positions in characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.functions import text as X

SIZE, OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", "")


def _cut_at(df: DataFrame, content: str, starts: Column, ends: Callable[[Column], Column]) -> DataFrame:
    rows = df.filter(F.length(content) > 0).select("*", F.posexplode(starts).alias("chunk_index", "start_pos"))
    rows = rows.withColumn("end_pos", ends(F.col("start_pos")).cast("int")).withColumn("start_pos", F.col("start_pos").cast("int"))
    piece = F.substring(F.col(content), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return rows.withColumn("chunk", piece).withColumn("token_count", X.token_estimate(F.col("chunk")))


def fixed(df: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size characters, each starting overlap before the last one's end; an overlap of the size or more means none.

    Adds chunk_index, start_pos, end_pos, chunk and token_count. Empty and null texts give no row.
    """
    n, step = F.length(content), size - overlap if overlap < size else size
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    return _cut_at(df, content, F.transform(F.sequence(F.lit(0), last), lambda i: i * step), lambda s: F.least(s + size, n))


def stream(df: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """What a reader with an overlap buffer gives: a window is followed by another one even if it ends exactly at the text's end."""
    n = F.length(content)
    if 0 < overlap < size:
        step = size - overlap
        last = F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / step) + 1).cast("int")
    else:
        step, last = size, (F.ceil(n / size) - 1).cast("int")
    return _cut_at(df, content, F.transform(F.sequence(F.lit(0), last), lambda i: i * step), lambda s: F.least(s + size, n))


def buffered(df: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows as in fixed, and if the text is longer than the overlap, one more chunk that holds the last overlap alone."""
    n = F.length(content)
    if not 0 < overlap < size:
        return stream(df, content, size, 0)
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    tail = F.when(n > overlap, F.array(n - overlap)).otherwise(F.array().cast("array<int>"))
    rows = _cut_at(df.withColumn("_last", last), content, F.concat(starts, tail), lambda s: F.when(F.col("chunk_index") > F.col("_last"), n).otherwise(F.least(s + size, n)))
    return rows.drop("_last")


def peek(df: DataFrame, n: int, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The first n windows of each text as buffered() gives them, without making the others."""
    head = df.withColumn(content, F.substring(content, 1, n * size)) if n > 0 else df.limit(0)
    return buffered(head, content, size, overlap).filter(F.col("chunk_index") < n)


# Packers run over each text once in Python workers: every piece depends on what the pieces before it left.

Piece = tuple[int, str]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[Piece]:
    have, start = "", 0
    for piece in pieces:
        if have and len(have) + len(piece) > size:
            yield start, have
            drop = max(0, len(have) - overlap)
            have, start = have[drop:], start + drop
        have += piece
    if have:
        yield start, have


def _recursive(text: str, size: int, overlap: int) -> Iterator[Piece]:
    if len(text) <= size:
        yield 0, text
    else:
        yield from _packed(text.split("\n\n"), size, overlap)


def _deep(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[Piece]:
    """Pieces of at most size that join to the text; the coarsest separator that works is used on each level and stays at its piece's end."""
    at = 0
    stack = [(text, 0)]
    have = ""
    while stack:
        part, level = stack.pop()
        if len(part) <= size or level >= len(separators):
            if len(have) + len(part) > size and have:
                yield at, have
                at += len(have)
                have = ""
            have += part
            continue
        sep = separators[level]
        bits = [part[i : i + size] for i in range(0, len(part), size)] if sep == "" else [b for b in re.split(f"(?<={re.escape(sep)})", part) if b]
        stack += [(b, level + 1) for b in reversed(bits)]
    if have:
        yield at, have


_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$")


def _semantic(text: str, size: int, overlap: int) -> Iterator[Piece]:
    have, start = "", 0
    for part in text.split("\n\n"):
        part = part.strip()
        if not part:
            continue
        if len(part) > size:
            if have:
                yield start, have
                have = ""
            for sentence in filter(None, map(str.strip, _SENTENCE.findall(part))):
                if have and len(have) + len(sentence) > size:
                    yield start, have
                    start, have = start + len(have), ""
                have += sentence
        elif have and len(have) + len(part) > size:
            yield start, have
            start, have = start + len(have), part
        else:
            have = f"{have}\n\n{part}" if have else part
    if have:
        yield start, have


def _lines(text: str, size: int, overlap: int) -> Iterator[Piece]:
    start, have = 0, ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        have += line
        if len(have) >= size:
            yield start, have
            start, have = start + len(have), ""
    if have:
        yield start, have


def _packer(pack: Callable[..., Iterator[Piece]], *args: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, s + len(c), c, len(c) // 4) for i, t in zip(b["id"], b["content"], strict=True) if t for k, (s, c) in enumerate(pack(t, *args))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start_pos", "end_pos", "chunk", "token_count"])

    return run


def _pack_with(df: DataFrame, id_col: str, content: str, pack: Callable, *args: int) -> DataFrame:
    rows = df.filter(F.length(content) > 0).select(F.col(id_col).alias("id"), F.col(content).alias("content"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInPandas(_packer(pack, *args), f"id {kind}, chunk_index int, start_pos int, end_pos int, chunk string, token_count int")
    return out.withColumnRenamed("id", id_col)


def recursive(df: DataFrame, id_col: str = "id", content: str = "content", size: int = SIZE, overlap: int = OVERLAP, deep: bool = False) -> DataFrame:
    """Paragraphs packed up to size, each chunk beginning with the last overlap characters of the one before.

    deep splits what is still too long at finer and finer separators instead, without overlap or loss.
    """
    return _pack_with(df, id_col, content, _deep, size) if deep else _pack_with(df, id_col, content, _recursive, size, overlap)


def semantic(df: DataFrame, id_col: str = "id", content: str = "content", size: int = SIZE) -> DataFrame:
    """Trimmed paragraphs packed up to size with blank lines between them; longer paragraphs by sentences."""
    return _pack_with(df, id_col, content, _semantic, size, 0)


def lines(df: DataFrame, id_col: str = "id", content: str = "content", size: int = SIZE) -> DataFrame:
    """Whole lines until size is reached."""
    return _pack_with(df, id_col, content, _lines, size, 0)


def build(mode: str, **options: int) -> Callable[[DataFrame], DataFrame]:
    """The chunker of a mode: default, line, buffered, fixed, recursive or semantic."""
    modes = {"default": stream, "line": lines, "buffered": buffered, "fixed": fixed, "recursive": recursive, "semantic": semantic}
    if mode not in modes:
        raise ValueError(f"no such chunker: {mode}")
    return lambda df: modes[mode](df, **options)
