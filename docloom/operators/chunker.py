"""Cutting texts into chunks by an ordered list of separators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators, the coarsest first; a colon is none, so that a label stays with its value.
SEPARATORS = ("\n\n", *(f"\n{'#' * n} " for n in range(1, 7)), "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def _atoms(text: str, start: int, end: int, size: int, level: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` characters that cover start..end; a separator stays at the head of the span behind it."""
    if end - start <= size:
        if end > start:
            yield start, end
        return
    sep = SEPARATORS[level]
    if not sep:
        yield from ((i, min(i + size, end)) for i in range(start, end, size))
        return
    cut, at = start, text.find(sep, start + 1, end)
    while at >= 0:
        yield from _atoms(text, cut, at, size, level + 1)
        cut, at = at, text.find(sep, at + len(sep), end)
    yield from _atoms(text, cut, end, size, level + 1)


def pieces(text: str, size: int = 900, overlap: int = 120) -> list[str]:
    """Chunks of at most ``size`` characters, stripped, none empty; neighbours share whole spans of at most ``overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    out: list[str] = []
    held: list[tuple[int, int]] = []
    for a, b in _atoms(text, 0, len(text), size, 0):
        if held and b - held[0][0] > size:
            if piece := text[held[0][0] : held[-1][1]].strip():
                out.append(piece)
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                held.pop(0)
        held.append((a, b))
    if held and (piece := text[held[0][0] : held[-1][1]].strip()):
        out.append(piece)
    return out


def chunk(segments: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """``document_id, chunk_id, chunk_index, total_chunks, text`` of ``segments(document_id, text)``.

    Null and blank texts give no rows; a document id counts once, and a null one takes no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, f"{doc}_c{i:04d}", i, len(found), p) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in [pieces(text, size, overlap)] for i, p in enumerate(found)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["document_id", "chunk_id", "chunk_index", "total_chunks", "text"])

    rows = segments.where("document_id is not null and text is not null").select("document_id", "text")
    return rows.mapInArrow(run, "document_id string, chunk_id string, chunk_index int, total_chunks int, text string").dropDuplicates(["chunk_id"])


def identity_clashes(chunks: DataFrame) -> DataFrame:
    """``chunk_id, sources`` of ids that more than one source uses: they would overwrite each other in an index."""
    return chunks.where("chunk_id is not null").select("chunk_id", "source_name").distinct().groupBy("chunk_id").agg(F.count("*").alias("sources")).where("sources > 1")
