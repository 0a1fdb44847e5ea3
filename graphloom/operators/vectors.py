"""Embedding of summaries and similarity search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import cosine

Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(size: int = 64) -> Callable[[], Encoder]:
    """A model-free encoder for tests: signed counts of hashed words."""

    def load() -> Encoder:
        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = [0.0] * size
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                    v[h % size] += 1.0 if h >> 63 else -1.0
                out.append(v)
            return out

        return encode

    return load


def embed_summaries(summaries: DataFrame, load: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """Summaries with embeddings where they had none; the model loads once a worker.

    A batch whose model call fails keeps a null embedding.
    """

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = []
            for at in range(0, len(part), batch):
                texts = [t or "" for t in part.iloc[at : at + batch]]
                try:
                    out += model(texts)
                except Exception:  # noqa: BLE001  a failing batch is skipped by contract
                    out += [None] * len(texts)
            yield pd.Series(out, index=part.index, dtype=object)

    todo = summaries.filter(F.col("embedding").isNull())
    return summaries.filter(F.col("embedding").isNotNull()).unionByName(todo.withColumn("embedding", embed("summary")))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 5, key: str = "id") -> DataFrame:
    """key, similarity of the k most similar vectors; ties by key; zero vectors take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.col("embedding").isNotNull()).select(key, cosine(F.col("embedding"), q).alias("similarity"))
    return scored.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key).limit(k)


def search_similar(summaries: DataFrame, text: str, encoder: Encoder, k: int = 5) -> DataFrame:
    return cosine_topk(summaries, encoder([text])[0], k)
