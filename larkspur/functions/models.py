"""Plug-in points for models, each with a deterministic offline default.

Models are called on Arrow batches. Any function with the same signature can take
a default's place: an embedder maps texts to vectors, a scorer maps (query, text)
pairs to numbers, a generator maps prompts to texts. A call that raises gives null
for its batch; callers decide what null means.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]

WORD = re.compile(r"\w+")


def hash_embedder(dimensions: int = 64) -> Embedder:
    """Signed feature hashing of words, L2-normalised; a text without words is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in enumerate(texts):
            for word in WORD.findall((text or "").lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                out[row, h % dimensions] += 1 if h >> 32 & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return embed


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Cosine of two sets of words."""
    out = []
    for query, text in zip(queries, texts, strict=True):
        a, b = (set(WORD.findall((x or "").lower())) for x in (query, text))
        out.append(len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0)
    return out


def template_generator(template: str = "{prompt}", most: int | None = None) -> Generator:
    """Answers with the template filled by the prompt (or its first characters)."""
    return lambda prompts: [template.replace("{prompt}", (p or "")[:most]) for p in prompts]


def embedded(text: Column, embedder: Embedder | None = None, batch: int = 128) -> Column:
    """Vectors of texts, ``batch`` texts a call."""
    chosen = embedder or hash_embedder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            calls = [chosen(part.iloc[at : at + batch].fillna("").tolist()) for at in range(0, len(part), batch)]
            yield pd.Series([v for c in calls for v in np.asarray(c, np.float32)], index=part.index, dtype=object)

    return run(text)


def scored(query: Column, text: Column, scorer: Scorer = overlap_scorer) -> Column:
    """Scores of pairs; a batch that fails scores null."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype=float)
        except Exception:  # noqa: BLE001  a plug-in may raise anything
            return pd.Series([None] * len(queries), dtype=float)

    return run(query, text)


def generated(prompt: Column, generator: Generator) -> Column:
    """Answers to prompts; a batch that fails is null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(generator(prompts.fillna("").tolist()), dtype=object)
        except Exception:  # noqa: BLE001  a plug-in may raise anything
            return pd.Series([None] * len(prompts), dtype=object)

    return run(prompt)
