"""Dictionary segmentation of Han text; other text as the Han tokenizer does."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.functions.text import han_tokens

_PARTS = re.compile(r"[㐀-鿿]+|[^\W_㐀-鿿]+")


class Dictionary:
    """Words with counts and classes. Modes: exact (best split), search (its words and the dictionary's shorter ones in them), all (every word that occurs)."""

    def __init__(self, words: dict[str, int], classes: dict[str, str] | None = None) -> None:
        self.words, self.classes = dict(words), dict(classes or {})
        self.total = sum(words.values()) or 1
        self.longest = max(map(len, words), default=1)

    @classmethod
    def from_table(cls, words: DataFrame) -> Dictionary:
        """From rows (word, count, class); of repeated words the counts are added. The table has to fit on the driver, as a dictionary does."""
        rows = words.filter("word is not null").groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("count"), F.max("class").alias("class")).collect()
        return cls({r["word"]: int(r["count"] or 1) for r in rows}, {r["word"]: r["class"] for r in rows if r["class"]})

    def add(self, word: str, count: int = 1, kind: str = "n") -> Dictionary:
        return Dictionary({**self.words, word: count}, {**self.classes, word: kind})

    def split(self, text: str) -> list[str]:
        """The split with the largest product of relative counts; unknown characters count as one occurrence."""
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(max(0, i - self.longest), i):
                n = self.words.get(text[j:i]) or (1 if i - j == 1 else 0)
                if n and (s := best[j][0] + math.log(n / self.total)) > best[i][0]:
                    best[i] = (s, j)
        out, i = [], len(text)
        while i:
            out.append(text[best[i][1] : i])
            i = best[i][1]
        return out[::-1]

    def inside(self, text: str) -> list[str]:
        return [text[i:j] for i in range(len(text)) for j in range(i + 1, min(len(text), i + self.longest) + 1) if text[i:j] in self.words]

    def tokens(self, text: str, mode: str = "exact") -> list[str]:
        out: list[str] = []
        for part in _PARTS.findall(text.lower()):
            if not "㐀" <= part[0] <= "鿿":
                out.append(part)
            elif mode == "all":
                out += self.inside(part) or list(part)
            else:
                for w in self.split(part):
                    out += [x for x in self.inside(w) if x != w and len(x) > 1] if mode == "search" else []
                    out.append(w)
        return out

    def tagged(self, text: str) -> list[tuple[str, str]]:
        return [(w, self.classes.get(w, "x")) for w in self.tokens(text)]


def tokenizer(dictionary: Dictionary | None = None, mode: str = "exact"):
    """A tokenizer for the keyword index; without a dictionary every Han character is a token."""
    if dictionary is None:
        return han_tokens

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([dictionary.tokens(t or "", mode) for t in s], dtype=object)

    def tokens(text: Column) -> Column:
        return run(text)

    return tokens


def tags(dictionary: Dictionary, text: Column) -> Column:
    """An array of (word, class) of the text's best split; x is the class of a word that the dictionary doesn't have."""

    @F.pandas_udf("array<struct<word: string, class: string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[{"word": w, "class": c} for w, c in dictionary.tagged(t or "")] for t in s], dtype=object)

    return run(text)
