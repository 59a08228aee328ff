"""Settings of the engine, checked when made."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunker: str = "recursive"
    top_k: int = 10
    rrf_k: int = 60
    fusion: str = "rrf"
    dimension: int = 64
    ivf_lists: int = 100
    hnsw_ef: int = 50
    dedup: bool = True

    def __post_init__(self) -> None:
        if self.chunk_size <= 0 or self.chunk_overlap < 0 or self.top_k <= 0 or self.dimension <= 0:
            raise ValueError("sizes must be positive")
        if self.fusion not in ("rrf", "weighted"):
            raise ValueError(f"no such fusion: {self.fusion}")

    def merged(self, other: dict) -> Config:
        """With the values of other that are set; unknown names are an error."""
        names = {f.name for f in fields(self)}
        if unknown := set(other) - names:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: expand(v) for k, v in other.items() if v is not None})


def expand(value: object) -> object:
    """${NAME} and ${NAME:-default} in a text are environment variables."""
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m.group(1), m.group(2) or ""), value)
