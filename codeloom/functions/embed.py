"""Embedding texts (EM1): a pluggable model, by default a hashing one that needs no network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMENSION = 768
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")


def hashing_model(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of signed word hashes; texts without words have zero vectors."""
    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in _WORD.findall(t or ""):
            h = zlib.crc32(w.lower().encode())
            out[i, h % dimension] += 1.0 if h & 0x80000000 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray] = hashing_model, batch: int = 16) -> DataFrame:
    """(key, embedding) with the model called on ``batch`` texts at a time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "embedding": list(model(part[text].tolist()))})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def retry_delay(headers: dict[str, str], attempt: int, most: float = 60.0) -> float:
    """FN23: seconds until another try: what the service asks for, in milliseconds or seconds, else twice as long each time from 2, at most ``most``."""
    for name, unit in (("retry-after-ms", 0.001), ("retry-after", 1.0)):
        try:
            return min(most, max(0.0, float(headers[name]) * unit))
        except (KeyError, ValueError):
            continue
    return min(most, 2.0 * 2 ** max(0, attempt - 1))
