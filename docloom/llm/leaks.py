"""Evaluation passages inside training documents.

Both sides are turned into windows of ``width`` consecutive words in which numbers, months, units and names stand as
typed placeholders. A name is every word that no evaluation text uses in lower case, so that a name that was put in
anew falls into the same slot as the one it replaces; whether it looks like a name is asked when the fillers are
compared. Document windows that hash to an evaluation window are joined with it; the words behind the placeholders tell
a literal copy from a re-parameterised one, whose placeholders must map one to one. A window that is little but
placeholders is no template: it is hashed by its very words.

Two bit sets of fixed size are sent to the tasks: the words that evaluation texts use in lower case, and the hashes of
evaluation windows, which keep most document windows from the join. Two words or hashes may share a bit; the join
compares the full hashes and the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import Marked, gathered, slot

WORD = re.compile(r"[^\W_]+")
# Words of measure and months, as written in lower case.
UNITS = frozenset("percent hours hour days day weeks week minutes minute seconds second years year kg g km m cm mm mb gb tb kb ms eur usd dollars euros metres meters miles litres pages".split())
MONTHS = frozenset("january february march april may june july august september october november december".split())
#: Bits of the two sets, ordinary words that make a window a template, and shares that a join key is split into.
WORD_BITS, WINDOW_BITS, LEAST_WORDS, SALTS = 24, 26, 5, 8


def kind_of(word: str, ordinary: Marked) -> str | None:
    """The placeholder a lower-case word stands for, or None for an ordinary word."""
    if any(c.isdigit() for c in word):
        return "<number>"
    if word in MONTHS:
        return "<month>"
    if word in UNITS:
        return "<unit>"
    return None if word in ordinary else "<name>"


def ordinary_words(items: DataFrame, bits: int = WORD_BITS) -> Marked:
    """Words without digits that ``items(text)`` use in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {w for text in batch.column(0).to_pylist() for w in WORD.findall(text) if w[0].islower()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted({slot(w, bits) for w in own}), pa.int64())], names=["slot"])

    return Marked(bits=bits, packed=gathered(items.select("text").where("text is not null").mapInArrow(run, "slot long"), bits))


class Hasher:
    """Hashes of template windows; equal words get equal numbers in every process."""

    def __init__(self, width: int, ordinary: Marked):
        self.width, self.ordinary = width, ordinary
        self.powers = np.array([pow(0x9E3779B97F4A7C15, width - i, 1 << 64) for i in range(width)], dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.own, self.typed, self.plain = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def _learn(self, word: str) -> int:
        """A lower-case word's own number, that of its placeholder (or its own), and 1 if it is ordinary."""
        n = len(self.known)
        if n == len(self.own):
            self.own, self.typed, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.own, self.typed, self.plain))
        own, kind = xxhash.xxh64_intdigest(word), kind_of(word, self.ordinary)
        self.own[n], self.typed[n], self.plain[n] = own, xxhash.xxh64_intdigest(kind) if kind else own, kind is None
        self.known[word] = n
        return n

    def windows(self, words: list[str]) -> np.ndarray:
        """Hash of the window at each position that has one."""
        n = len(words) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        if len(self.known) > 500_000:
            self._forget()
        known, learn = self.known.get, self._learn
        ids = np.fromiter((k if (k := known(w)) is not None else learn(w) for w in words), np.int64, len(words))
        own, typed, plain = self.own[ids], self.typed[ids], self.plain[ids]
        template, literal = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i, p in enumerate(self.powers):
            template += typed[i : i + n] * p
            literal += own[i : i + n] * p
        count = np.concatenate([[0], np.cumsum(plain)])
        out = np.where(count[self.width :] - count[: -self.width] >= LEAST_WORDS, template, literal)
        out ^= out >> np.uint64(29)
        return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def consistent(a: list[str], b: list[str], ordinary: Marked) -> bool:
    """Whether two windows (as written) of one template fill its slots alike: equal fillers on one side stand for equal
    ones on the other, and a name stands for a capitalised word."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for x, y in zip(a, b):
        u, v = x.lower(), y.lower()
        s = kind_of(u, ordinary)
        if s != kind_of(v, ordinary) or s is None and u != v:
            return False
        if s == "<name>" and u != v and not (x[0].isupper() and y[0].isupper()):
            return False
        if s and (there.setdefault(u, v) != v or back.setdefault(v, u) != u):
            return False
    return True


def windows_of(df: DataFrame, key: str, width: int, ordinary: Marked, only: np.ndarray | None = None) -> DataFrame:
    """``<key>, window, words`` for each window of ``text``, or for those whose hash is in the bit set ``only``."""
    sent = df.sparkSession.sparkContext.broadcast((ordinary, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, only = sent.value
        hasher = Hasher(width, ordinary)
        for batch in batches:
            keys, hashes, texts = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = text.lower()
                words = WORD.findall(low)
                h = hasher.windows(words)
                if only is not None and len(h):
                    at = h.view(np.uint64) & np.uint64((1 << WINDOW_BITS) - 1)
                    hits = np.flatnonzero(only[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                else:
                    hits = range(len(h))
                if len(hits):
                    written = WORD.findall(text)
                    # lower case can part or join words in rare scripts; then the lower-case words stand for the written ones
                    written = written if len(written) == len(words) else words
                    for i in hits:
                        keys.append(k)
                        hashes.append(int(h[i]))
                        texts.append(" ".join(written[i : i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=[key, "window", "words"])

    return df.select(F.col(key).cast("long").alias(key), "text").where(f"text is not null and {key} is not null").mapInArrow(run, f"{key} long, window long, words string")


def leaks(documents: DataFrame, items: DataFrame, width: int = 12) -> DataFrame:
    """``doc_id, item_id, literal_windows, template_windows``: documents that hold a window of an evaluation item.

    ``literal_windows`` counts the document's distinct windows with the very words of the item, ``template_windows``
    those whose placeholders are filled consistently but otherwise; case does not matter to either count, but a name
    that was put in anew must be capitalised. Null or short texts match nothing; repeated rows count once; other columns
    are ignored.
    """
    spark = documents.sparkSession
    ordinary = ordinary_words(items)
    of = windows_of(items, "item_id", width, ordinary).dropDuplicates(["item_id", "window", "words"])
    low = F.col("window").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).alias("slot")
    only = gathered(of.select(low), WINDOW_BITS)
    # a window that stands in very many documents is met in SALTS tasks
    inside = windows_of(documents, "doc_id", width, ordinary, only).dropDuplicates(["doc_id", "window", "words"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    there = of.withColumnRenamed("words", "item_words").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = inside.join(there, ["window", "salt"]).select("doc_id", "item_id", "words", "item_words")
    sent = spark.sparkContext.broadcast(ordinary)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = sent.value
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kinds = [0 if (u := x.lower()) == (v := y.lower()) else 1 if consistent(x.split(" "), y.split(" "), ordinary) else 2 for x, y in zip(a, b)]
            words = pa.array([x.lower() for x in a], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, pa.array(kinds, pa.int8())], names=["doc_id", "item_id", "words", "kind"])

    kinds = both.mapInArrow(compare, "doc_id long, item_id long, words string, kind byte").where("kind < 2")
    return (
        kinds.groupBy("doc_id", "item_id", "words").agg(F.min("kind").alias("kind"))
        .groupBy("doc_id", "item_id")
        .agg(F.count_if(F.col("kind") == 0).alias("literal_windows"), F.count_if(F.col("kind") == 1).alias("template_windows"))
    )


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of documents that share a run of 12 words with an item."""
    return leaks(documents, items).where("literal_windows > 0").select("doc_id", "item_id")
