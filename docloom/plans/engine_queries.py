"""Queries of the engine's entry points over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed, index
from ..session import table
from . import engine
from .text_queries import segments

MODEL = embed.HashingEmbedder(64)
SCALE = 0.6


def vectors(s, d):
    """Vectors of all chunks by the model without weights."""
    return embed.embedded(index.stored(table(s, d, "chunks")).select("chunk_id", "text"), "chunk_id", MODEL)


def asked(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))


def ask(s, d):
    """All evaluation questions against all chunks."""
    out = engine.ask(asked(s, d), table(s, d, "chunks"), vectors(s, d), MODEL, distance_scale=SCALE)
    return out.select("query_id", "route", "answer", F.size("sources").alias("sources"))


def sync(s, d):
    """The index of the whole library, from nothing: one row for each chunk with its vector's length."""
    rows = segments(s, d)
    empty = table(s, d, "chunks").limit(0)
    hashes = s.createDataFrame([], "source_name string, sha string")
    cache = s.createDataFrame([], "model string, sha string, embedding array<float>")
    chunks, found, _, _ = engine.sync(rows, empty, hashes, cache, MODEL)
    return chunks.join(found, "chunk_id").select("chunk_id", "source_name", F.size("embedding").alias("dims"))


QUERIES = {"ask_batch": (ask, None), "sync_index": (sync, None)}
