"""Embedding texts: a protocol for models, a model without weights, and a cache by content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
BATCH = 64


class Embedder(Protocol):
    """A model: its name, its dimension, and vectors for a batch of texts. It must be picklable."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of tokens and pairs of tokens, of unit length: needs no weights and no network."""

    def __init__(self, dims: int = 64):
        self.dims, self.name = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            words = TOKEN.findall(text.lower())
            for w in (*words, *map(" ".join, zip(words, words[1:]))):
                h = xxhash.xxh64_intdigest(w)
                row[(h >> 1) % self.dims] += 1.0 if h & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


def embedded(texts: DataFrame, key: str, model: Embedder) -> DataFrame:
    """``<key>, embedding`` of ``texts(<key>, text)``; null texts take no part."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            vectors = [v for at in range(0, len(found), BATCH) for v in model.embed(found[at : at + BATCH]).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], names=[key, "embedding"])

    return texts.where("text is not null").select(key, "text").mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def with_cache(texts: DataFrame, key: str, cache: DataFrame, model: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors of all texts, and the cache with those that were missing.

    ``cache(model, sha, embedding)``; a text that occurs often is embedded once, and one in the cache not at all.
    """
    rows = texts.where("text is not null").select(key, "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    known = cache.where(F.col("model") == model.name).select("sha", "embedding")
    misses = rows.select("sha", "text").dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti")
    new = embedded(misses, "sha", model)
    have = known.unionByName(new)
    grown = cache.unionByName(new.select(F.lit(model.name).alias("model"), "sha", "embedding"))
    return rows.select(key, "sha").join(have, "sha").select(key, "embedding"), grown
