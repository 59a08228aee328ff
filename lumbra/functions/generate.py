"""Text generation behind one function, with a deterministic stand-in and clients for chat services."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib import request

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Generate = Callable[[str], str]


@dataclass(frozen=True)
class Options:
    temperature: float = 0.7
    max_tokens: int = 1024
    top_p: float = 1.0
    stop: tuple[str, ...] = field(default=())


def mock(prefix: str = "answer: ") -> Generate:
    """The same answer for the same prompt: the prefix and the prompt's last line."""
    return lambda prompt: prefix + (prompt.strip().rsplit("\n", 1)[-1] if prompt.strip() else "")


def chat(url: str, model: str, key: str | None = None, options: Options = Options(), timeout: float = 30.0) -> Generate:
    """A client of a service with the common chat completion interface."""

    def run(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": options.temperature, "max_tokens": options.max_tokens, "top_p": options.top_p}
        if options.stop:
            body["stop"] = list(options.stop)
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with request.urlopen(request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as answer:  # noqa: S310
            data = json.load(answer)
        return data["choices"][0]["message"]["content"] if "choices" in data else data.get("message", {}).get("content") or data.get("response", "")

    return run


def generated(prompt: Column, generate: Generate, tries: int = 1, good: Callable[[str], bool] = bool) -> Column:
    """The model's answer to each prompt, in Arrow batches with one model for a task; one that isn't good is asked for again, up to tries times. A null prompt is empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for p in s:
                answer = ""
                for _ in range(max(1, tries)):
                    answer = generate(p or "")
                    if good(answer or ""):
                        break
                out.append(answer)
            yield pd.Series(out, dtype=object)

    return run(prompt)


def streamed(url: str, model: str, key: str | None = None, options: Options = Options(), timeout: float = 30.0) -> Callable[[str], Iterator[str]]:
    """A client that passes on the answer's pieces as the service sends them: lines of events, or of JSON values."""

    def run(prompt: str) -> Iterator[str]:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": options.temperature, "max_tokens": options.max_tokens, "stream": True}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with request.urlopen(request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as answer:  # noqa: S310
            for line in answer:
                text = line.decode().strip().removeprefix("data:").strip()
                if not text or text == "[DONE]":
                    continue
                data = json.loads(text)
                part = data["choices"][0].get("delta", {}).get("content") if data.get("choices") else data.get("message", {}).get("content") or data.get("response")
                if part:
                    yield part
                if data.get("done"):
                    return

    return run


def pieces(answer: str, size: int = 20) -> Iterator[str]:
    """The answer as a stream of pieces."""
    for i in range(0, len(answer), size):
        yield answer[i : i + size]
