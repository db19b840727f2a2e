"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a session setting or the parameter ``vocabulary`` replaces it.
VOCABULARY = os.environ.get("DOCLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the usual splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a ``.tiktoken`` rank file, loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _loaded[path] = tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``tokens``, the number of tokens of ``text`` (0 for null). Very long texts are counted in
    runs of 100,000 characters cut at blanks, as the tokenizer's time grows faster than its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            counts = [sum(len(tokenizer.encode_ordinary(p)) for p in _runs(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, f"{fields}, tokens long")


def _runs(text: str, most: int = 100_000) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text) and (space := text.rfind(" ", at + 1, end)) > at:
            end = space
        yield text[at:end]
        at = end
