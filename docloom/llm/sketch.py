"""Word statistics of a whole corpus in a fixed number of bits.

A word falls into one of ``2 ** BITS`` slots by its hash. The size does not grow with the data: two words in one slot
share its answer, which the more frequent of them gives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
WORD = re.compile(r"[^\W\d_]+")
_letters: list[np.ndarray] = []


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``text``, and which of them stand in words."""
    if not _letters:  # of the first planes; the few characters beyond them are looked at one by one
        _letters.append(np.zeros(0x20000, bool))
        for m in WORD.finditer("".join(map(chr, range(0x20000)))):
            _letters[0][m.start() : m.end()] = True
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters[0].take(points, mode="clip")
    for at in np.flatnonzero(points >= 0x20000):
        inside[at] = WORD.match(text[at]) is not None
    return points, inside


def words(points: np.ndarray, inside: np.ndarray) -> list[str]:
    """What ``WORD`` finds in a text, of which ``letters`` gives the arguments."""
    return np.where(inside, points, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").split()


def slot(word: str, bits: int = BITS) -> int:
    """The slot of a lower-case word."""
    return xxhash.xxh64_intdigest(word) & ((1 << bits) - 1)


class Marked:
    """A set of slots; ``word in marked`` asks for the word's slot."""

    def __init__(self, words: Iterable[str] = (), bits: int = BITS, packed: np.ndarray | None = None):
        self.bits = bits
        self.packed = np.zeros(1 << bits - 6, np.uint64) if packed is None else packed
        for w in words:
            at = slot(w, bits)
            self.packed[at >> 6] |= np.uint64(1 << (at & 63))
        self.known: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            at = slot(word, self.bits)
            hit = bool(int(self.packed[at >> 6]) >> (at & 63) & 1)
            if len(self.known) < 500_000:
                self.known[word] = hit
        return hit

    def __reduce__(self):
        return Marked, ((), self.bits, self.packed)


def gathered(slots: DataFrame, bits: int) -> np.ndarray:
    """The bits of ``slots(slot)`` as 64-bit words; at most ``2 ** (bits - 6)`` rows reach the driver, whatever the data."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return out


def lower_words(texts: DataFrame, bits: int = BITS) -> Marked:
    """Words of ``texts(text)`` that stand in lower case more often than not; words that never do are names, as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 500):
                seen.update(words(*letters("\n".join(texts[k : k + 500]))))
            if len(seen) > 300_000:
                yield summed(seen)
                seen = Counter()
        yield summed(seen)

    def summed(seen: Counter[str]) -> pa.RecordBatch:
        slots = np.fromiter((slot(w.lower(), bits) for w in seen), np.int64, len(seen))
        n = np.fromiter((c if w[0].islower() else -c for w, c in seen.items()), np.int64, len(seen))
        at, of = np.unique(slots, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, of, n)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], names=["slot", "n"])

    usual = texts.select("text").where("text is not null").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 0")
    return Marked(bits=bits, packed=gathered(usual, bits))
