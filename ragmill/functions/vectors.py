"""Vectors: norms, distances, half precision, and a deterministic embedder for tests without a model."""

from __future__ import annotations

import zlib
from itertools import chain
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Places(dict):
    """Twice the axis of a word, and one where it adds; a word is hashed once."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        self[word] = got = h % self.size * 2 + (h >> 31)
        return got


class HashingEmbedder:
    """Unit vectors of hashed words; a text without words gets the first axis."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        places = Places(self.size)
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        out = np.bincount(row * self.size + (at >> 1), (at & 1) * 2.0 - 1, len(texts) * self.size).reshape(-1, self.size).astype(np.float32)
        n = np.linalg.norm(out, axis=1)
        out[n == 0, 0] = 1
        return out / np.where(n == 0, 1, n)[:, None]


def embed(df: DataFrame, text: str, embedder: Embedder, to: str = "embedding", batch: int = 1024) -> DataFrame:
    """``df`` with the unit vector of each text, encoded in Arrow batches; rows are never gathered."""

    @F.pandas_udf("array<float>")
    def run(s):
        import pandas as pd

        rows = []
        for at in range(0, len(s), batch):
            v = np.asarray(embedder.encode(s.iloc[at : at + batch].fillna("").tolist()), np.float32)
            rows += list(v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None])
        return pd.Series(rows, index=s.index)

    return df.withColumn(to, run(text))


def half_precision(df: DataFrame, vector: str, to: str) -> DataFrame:
    """Vectors as they come back from 16-bit storage."""

    @F.pandas_udf("array<float>")
    def run(s):
        return s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return df.withColumn(to, run(vector))


#: Token budget of an encoder batch and most texts in it, by a part of the model's name.
BUDGETS = {"minilm": (6_000_000, 64_000), "large": (250_000, 512), "": (1_200_000, 16_000)}
#: Tokens beyond which a large model takes fewer texts.
LARGE_STEPS = ((200, 256), (450, 128))


def batch_size(longest: int, model: str, device: str = "cuda") -> int:
    """Texts encoded together when the longest has ``longest`` characters: what the model's token budget holds, a third of
    the characters being tokens that weigh more beyond 512, from 16 to the model's most. Without a graphics card 32."""
    if device in ("cpu", "mps"):
        return 32
    kind = next(k for k in BUDGETS if k in model.lower())
    tokens = max(longest / 3, 1.0)
    budget, most = BUDGETS[kind]
    fits = int(budget / (1 + tokens / 1024 if tokens > 512 else 1.0) / tokens)
    if kind == "large":
        most = min([most] + [n for above, n in LARGE_STEPS if tokens > above])
    return min(max(fits, 16), most)


def fixed_batch_size(model: str) -> int:
    name = model.lower()
    return 8192 if "minilm" in name else 1536 if "bge-base" in name else 256 if "bge-large" in name else 1024
