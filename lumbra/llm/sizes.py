"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of byte-pair ranks that every executor can read; a parameter of everything that counts tokens. The session's setting of this name comes before the default.
SETTING = "spark.lumbra.tokenizer.ranks"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's publisher splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = RANKS) -> int:
    """Tokens of the whole text; 0 for null. Strings of special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def _sizer(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count(t, path) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return run


def sized(docs: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """The kept columns with tokens, the size of the text; the text itself goes no further."""
    path = docs.sparkSession.conf.get(SETTING, RANKS) if path == RANKS else path
    rows = docs.select(*keep, F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_sizer(path, keep), ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["tokens long"]))
