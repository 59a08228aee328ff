"""Embedders: functions of a batch of texts, run in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from urllib import request

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]

# What a model family wants before a query and before a passage.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("", ""), "none": ("", "")}
BATCH = 32


def clean(text: Column) -> Column:
    """Trimmed; an empty or null text is one space."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(" ")).otherwise(t)


def hashing(dim: int = 64) -> Embedder:
    """Deterministic: the first 32 bits of a word's MD5 give its position and sign, the sum is brought to length 1."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4], "big")
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def service(url: str, model: str, key: str | None = None, timeout: float = 30.0) -> Embedder:
    """A client of a service with the common embeddings interface: it takes a list of texts and gives a vector for each, with its place in the list."""

    def run(texts: list[str]) -> np.ndarray:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with request.urlopen(request.Request(url, json.dumps({"model": model, "input": texts}).encode(), head), timeout=timeout) as answer:  # noqa: S310
            data = json.load(answer)
        rows = data["data"] if "data" in data else [{"index": i, "embedding": e} for i, e in enumerate(data["embeddings"])]
        if len(rows) != len(texts):
            raise RuntimeError(f"{len(texts)} texts, but {len(rows)} vectors")
        return np.array([r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))], dtype=float)

    return run


def constant(dim: int = 64) -> Embedder:
    """The same vector for every text."""
    return lambda texts: np.full((len(texts), dim), 1 / dim**0.5)


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "vector", family: str = "none", query: bool = False, normalise: bool = True, batch: int = BATCH) -> DataFrame:
    """Adds the vector of the text; the embedder gets at most batch texts at a time, as a remote service would."""
    prefix = PREFIXES[family][0 if query else 1]

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [prefix + t for t in s]
            x = np.concatenate([embedder(texts[i : i + batch]) for i in range(0, len(texts), batch)]) if texts else np.zeros((0, 1))
            if normalise:
                x = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
            yield pd.Series(list(x))

    return df.withColumn(out, run(clean(F.col(text))))
