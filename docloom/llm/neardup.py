"""Near-duplicate texts by signature trees.

A text is the set of its runs of ``width`` words. It gets a signature: a bitmap onto which its tokens are hashed, and
its size. Texts with the same token set form one class with one representative. Representatives stand in ``bands``
signature trees. The first level of a tree is an inverted list: its nodes are tokens, and a text stands below the one of
its tokens that comes first in the tree's own random order. Below that, texts are clustered by their bitmaps and sizes,
and every node holds the OR of the bitmaps below it and the range of sizes. A dual traversal of each such subtree starts
with its root against itself and drops every pair of nodes whose largest possible overlap cannot reach the threshold;
pairs of texts that survive the same bound on their own bitmaps are verified on the words. ``pruning`` reports how many
node pairs are dropped.

One tree under a single root would compare every node with every other, as the OR of many bitmaps is full; the first
level is what makes the work grow with the data. Two texts of similarity s stand below the same token in a tree with
probability s, so a pair is missed by all trees with (1 - s) ** bands; below a token no pair is lost.

A subtree that holds more than ``hot`` texts is cut into blocks of similar size; the blocks' nodes are joined first,
under the same bound, and only the surviving pairs of blocks are joined with their rows, so that no task ever holds a
whole subtree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_collect, cut, kept, wide_partitions

WORD = re.compile(r"[^\W_]+")
BITS = 768
#: Texts of a leaf, children of a node, and texts up to which a subtree is one leaf that is read as it is.
LEAF, FAN, SMALL = 2, 16, 16
#: Node pairs looked at together, and the share of texts on which the size of a subtree is estimated.
AT_ONCE, SAMPLED = 16_384, 64
#: Texts that are signed together, so that their arrays stay near.
SLICE = 256
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class _Numbers(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, w: str) -> int:
        n = xxhash.xxh64_intdigest(w)
        if len(self) < 500_000:
            self[w] = n
        return n


class Shingler:
    """64-bit hashes of runs of words, alike in every process."""

    def __init__(self, width: int, least_words: int):
        self.width, self.least, self.known = width, least_words, _Numbers()

    @staticmethod
    def class_of(tokens: np.ndarray) -> int:
        """The class of a token set."""
        return int(_mix(_mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])

    def tokens(self, text: str | None) -> np.ndarray | None:
        """Distinct hashes in order; None for a text with too few words."""
        words = WORD.findall(text.lower()) if text else ()
        if len(words) < max(self.least, self.width):
            return None
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(ids) - self.width + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.width):
            out = (out + ids[i : i + n]) * MULTIPLY
            out ^= out >> np.uint64(32)
        out.sort()
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(out[1:], out[:-1], out=first[1:])
        return out[first]


def signatures(texts: DataFrame, key: str, width: int, least_words: int, bands: int) -> DataFrame:
    """``<key>, cls, n, b0.., bands``: class, size, bitmap and tree keys of every text that takes part."""
    fields = ", ".join(["cls long", "n int", *(f"b{i} long" for i in range(BITS // 64)), "bands array<long>"])
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, least_words)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            keep, sets = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if (t := shingler.tokens(text)) is not None:
                    keep.append(i)
                    sets.append(t)
            if not sets:
                continue
            n = np.array([len(s) for s in sets])
            flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
            row = np.repeat(np.arange(len(sets)), n)
            marks = np.zeros((len(sets), BITS), np.uint8)
            marks[row, (flat >> np.uint64(20)) % np.uint64(BITS)] = 1
            bits = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
            cls = _mix(np.add.reduceat(_mix(flat), starts) + n.astype(np.uint64)).view(np.int64)
            named = np.empty((len(sets), bands), np.uint64)
            high = flat >> np.uint64(17)
            for k in range(bands):
                named[:, k] = np.minimum.reduceat(flat * factors[k] ^ high * shifts[k], starts)
            named = _mix(named + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * MULTIPLY)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(cls), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1])), lists(named)],
                names=[key, "cls", "n", *(f"b{i}" for i in range(bits.shape[1])), "bands"],
            )

    return texts.select(F.col(key).cast("string").alias(key), "text").mapInArrow(run, f"`{key}` string, {fields}")


class Nodes:
    """Nodes of one level: ORs of bitmaps (word by word), smallest and largest sizes, and tokens beyond the bits. Texts are
    nodes of one text."""

    def __init__(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray):
        self.words, self.low, self.high, self.slack = words, low, high, slack

    @classmethod
    def of_texts(cls, bits: np.ndarray, n: np.ndarray) -> Nodes:
        return cls(np.ascontiguousarray(bits.T), n, n, n - np.bitwise_count(bits).sum(1))

    def above(self, size: int) -> Nodes:
        """Nodes that each hold ``size`` of these."""
        at = np.arange(0, len(self.low), size)
        return Nodes(np.bitwise_or.reduceat(self.words, at, axis=1), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.slack, at))


def possible(p: Nodes, q: Nodes, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether any text below node x of ``p`` can reach the threshold with any below node y of ``q``, for arrays of nodes."""
    shared = np.zeros(len(x), np.int64)
    for a, b in zip(p.words, q.words):
        shared += np.bitwise_count(a[x] & b[y])
    plo, qlo, phi, qhi = p.low[x], q.low[y], p.high[x], q.high[y]
    over = np.minimum(shared + np.minimum(p.slack[x], q.slack[y]), np.minimum(phi, qhi))
    return (over * (1 + threshold) >= threshold * (plo + qlo) - 1e-9) & (phi >= threshold * qlo - 1e-9) & (qhi >= threshold * plo - 1e-9)


def clustered(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An order in which similar bitmaps, of similar size, stand together: by the first set bits in random orders."""
    rng, each = np.random.default_rng(7), np.unpackbits(bits.view(np.uint8), axis=1)
    firsts = [each[:, rng.permutation(each.shape[1])].argmax(1) for _ in range(4)]
    return np.lexsort((n, *firsts))


def build(texts: Nodes) -> list[Nodes]:
    """Levels of the tree from the leaves up."""
    levels = [texts.above(LEAF)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above(FAN))
    return levels


def traverse(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, threshold: float, seen: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of possible pairs between two trees' rows (bitmaps, sizes), or within one tree if ``b`` is None.

    ``seen`` takes up, by level, the node pairs compared and those dropped; level -1 is pairs of texts.
    """
    oa, same = clustered(*a), b is None
    a = Nodes.of_texts(a[0][oa], a[1][oa])
    ob = oa if same else clustered(*b)
    b = a if same else Nodes.of_texts(b[0][ob], b[1][ob])
    ta = build(a)
    tb = ta if same else build(b)
    while len(ta) < len(tb):
        ta.append(ta[-1])
    while len(tb) < len(ta):
        tb.append(tb[-1])
    seen = {} if seen is None else seen

    def note(level: int, ok: np.ndarray) -> None:
        count = seen.setdefault(level, [0, 0])
        count[0] += len(ok)
        count[1] += len(ok) - int(ok.sum())

    outx, outy = [], []
    todo = [(len(ta) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, x, y = todo.pop()
        if len(x) > AT_ONCE:
            todo.append((level, x[AT_ONCE:], y[AT_ONCE:]))
            x, y = x[:AT_ONCE], y[:AT_ONCE]
        ok = possible(ta[level], tb[level], x, y, threshold)
        note(level, ok)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if level:
            x, y = _pairs(_kids(x, len(ta[level].low), len(ta[level - 1].low)), _kids(y, len(tb[level].low), len(tb[level - 1].low)))
            if same:
                keep = x <= y
                x, y = x[keep], y[keep]
            todo.append((level - 1, x, y))
            continue
        i, j = _pairs(_texts(x, len(a.low)), _texts(y, len(b.low)))
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        ok = possible(a, b, i, j, threshold)
        note(-1, ok)
        outx.append(i[ok])
        outy.append(j[ok])
    return (oa[np.concatenate(outx)], ob[np.concatenate(outy)]) if outx else (np.zeros(0, np.int64),) * 2


def _texts(leaves: np.ndarray, count: int) -> np.ndarray:
    """Ranges of the texts of leaves."""
    return np.stack([leaves * LEAF, np.minimum((leaves + 1) * LEAF, count)], axis=1)


def _kids(nodes: np.ndarray, here: int, below: int) -> np.ndarray:
    """Ranges of child nodes; a level that only repeats the one below has itself as child."""
    return np.stack([nodes, nodes + 1], axis=1) if here == below else np.stack([nodes * FAN, np.minimum((nodes + 1) * FAN, below)], axis=1)


def _pairs(l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each left range with the right range at its place."""
    nl, nr = l[:, 1] - l[:, 0], r[:, 1] - r[:, 0]
    size = nl * nr
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return l[of, 0] + at // nr[of], r[of, 0] + at % nr[of]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def within_buckets(rows: DataFrame, threshold: float, stats: bool = False) -> DataFrame:
    """``a, b`` (classes, a < b) of the possible pairs in each bucket of ``rows(key, cls, n, b0..)``; with ``stats`` instead
    ``level, pairs, dropped`` of the traversals."""
    ordered = rows.repartition(wide_partitions(rows), "key").sortWithinPartitions("key", "n")

    def pairs_of(key: np.ndarray, cls: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        small, texts = np.repeat(size <= SMALL, size), Nodes.of_texts(bits, n)
        outs, seen = [], {}
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]))
            if not len(i):
                break
            i = i[possible(texts, texts, i, i + d, threshold)]
            outs.append(np.stack([cls[i], cls[i + d]]))
        for s, m in zip(starts[size > SMALL], size[size > SMALL]):
            i, j = traverse((bits[s : s + m], n[s : s + m]), None, threshold, seen)
            outs.append(np.stack([cls[s + i], cls[s + j]]))
        if stats:
            return pa.RecordBatch.from_arrays([pa.array([*seen], pa.int32()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["level", "pairs", "dropped"])
        both = np.concatenate(outs, axis=1) if outs else np.zeros((2, 0), np.int64)
        both = np.unique(np.sort(both[:, both[0] != both[1]], axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _columns(batch)
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            kept = [x[last:] for x in now]
            if last:
                yield pairs_of(now[0][:last], now[1][:last], now[2][:last].astype(np.int64), np.stack([x[:last] for x in now[3:]], axis=1).view(np.uint64))
        if kept is not None:
            yield pairs_of(kept[0], kept[1], kept[2].astype(np.int64), np.stack(kept[3:], axis=1).view(np.uint64))

    return ordered.mapInArrow(run, "level int, pairs long, dropped long" if stats else "a long, b long")


def between_blocks(rows: DataFrame, threshold: float, block: int, stats: bool = False) -> DataFrame:
    """``a, b`` of the possible pairs in buckets of any size, by a dual traversal that starts at blocks; with ``stats`` instead
    ``level, pairs, dropped`` of the traversals.

    Rows of a bucket are put into blocks of about ``block`` rows by size; block nodes are paired under the node bound,
    and each surviving pair of blocks becomes one task-sized group.
    """
    cols = ["cls", "n", *(f"b{i}" for i in range(BITS // 64))]
    counts = rows.groupBy("key", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(counts.withColumn("before", F.coalesce(before, F.lit(0))), ["key", "n"])
    # a size with more than a block's rows is spread over several blocks by its class
    blocks = cut(
        placed.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("cls"), F.col("c"))) / block)).select("key", "block", *cols)
    )
    ors = [F.bit_or(f"b{i}").alias(f"o{i}") for i in range(BITS // 64)]
    filled = sum((F.bit_count(f"b{i}") for i in range(BITS // 64)), F.lit(0))
    nodes = blocks.groupBy("key", "block").agg(*ors, F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - filled).alias("slack"))
    q = nodes.select("key", *[F.col(c).alias(f"q_{c}") for c in nodes.columns if c != "key"])
    shared = sum((F.bit_count(F.col(f"o{i}").bitwiseAND(F.col(f"q_o{i}"))) for i in range(BITS // 64)), F.lit(0))
    over = F.least(shared + F.least("slack", "q_slack"), "hi", "q_hi")
    surviving = nodes.join(q, "key").where(
        (F.col("block") <= F.col("q_block")) & (over * (1 + threshold) >= threshold * (F.col("lo") + F.col("q_lo"))) & (F.col("hi") >= threshold * F.col("q_lo")) & (F.col("q_hi") >= threshold * F.col("lo"))
    ).select("key", "block", "q_block")
    left = surviving.join(blocks, ["key", "block"]).withColumn("side", F.lit(0))
    right = surviving.join(blocks.withColumnRenamed("block", "q_block"), ["key", "q_block"]).withColumn("side", F.lit(1))

    def join(group: pa.Table) -> pa.Table:
        sides = []
        for s in (0, 1):
            part = group.filter(pc.equal(group["side"], s)).sort_by("n")
            sides.append((part["cls"].to_numpy(), (np.stack([part[f"b{i}"].to_numpy() for i in range(BITS // 64)], axis=1).view(np.uint64), part["n"].to_numpy().astype(np.int64))))
        seen: dict[int, list[int]] = {}
        i, j = traverse(sides[0][1], sides[1][1], threshold, seen)
        if stats:
            return pa.table({"level": pa.array([*seen], pa.int32()), "pairs": pa.array([v[0] for v in seen.values()], pa.int64()), "dropped": pa.array([v[1] for v in seen.values()], pa.int64())})
        both = np.stack([sides[0][0][i], sides[1][0][j]])
        both = np.unique(np.sort(both[:, both[0] != both[1]], axis=0), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return left.unionByName(right).groupBy("key", "block", "q_block").applyInArrow(join, "level int, pairs long, dropped long" if stats else "a long, b long")


def candidates(reps: DataFrame, threshold: float, hot: int, block: int, stats: bool = False) -> DataFrame:
    """``a, b``: class pairs that pass the signature bounds somewhere in the forest; with ``stats`` instead ``level, pairs,
    dropped`` of the traversals."""
    cols = ["cls", "n", *(f"b{i}" for i in range(BITS // 64))]
    rows = reps.select(F.explode("bands").alias("key"), *cols)
    # A subtree's size is estimated on one text in SAMPLED; both ways below keep every pair of a subtree, so a wrong guess
    # costs time only.
    sampled = rows.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("c"))
    hot_keys = cut(sampled.where(F.col("c") * SAMPLED > hot).select("key"))
    if hot_keys.isEmpty():
        return within_buckets(rows, threshold, stats)
    known = bounded_collect(hot_keys, 10_000)
    by = F.broadcast(hot_keys) if known is not None else hot_keys
    cold = within_buckets(rows.join(by, "key", "left_anti"), threshold, stats)
    return cold.unionByName(between_blocks(rows.join(by, "key", "left_semi"), threshold, block, stats))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, least_words: int) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach the threshold on their words; ``texts(cls, text)`` has one row a class."""
    a, b = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, least_words)
        for batch in batches:
            out = []
            for x, y, tx, ty in zip(*(batch.column(i).to_pylist() for i in range(4))):
                p, q = shingler.tokens(tx), shingler.tokens(ty)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append((x, y, both / (len(p) + len(q) - both)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(
    texts: DataFrame, key: str = "chunk_id", threshold: float = 0.5, width: int = 3, least_words: int = 20, bands: int = 7, hot: int = 20_000, block: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """Class pairs and membership of ``texts(<key>, text)``.

    Pairs: ``a, b, similarity`` (classes, a < b, Jaccard of the sets of runs of ``width`` words at least ``threshold``).
    Membership: ``<key>, cls, representative, copies``; the texts of a class have the same token set. Texts with fewer
    than ``least_words`` words, null texts and null keys take no part; rows that repeat a key count once, under the
    smallest of their classes; other columns are ignored.
    """
    sig = kept(signatures(texts.where(F.col(key).isNotNull() & F.col("text").isNotNull()), key, width, least_words, bands))
    members = sig.groupBy(key).agg(F.min("cls").alias("cls"))
    classes = members.groupBy("cls").agg(F.min(key).alias("representative"), F.count("*").alias("copies"))
    reps = sig.drop(key).dropDuplicates(["cls"])
    pairs = cut(candidates(reps, threshold, hot, block).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("cls", F.col("representative").alias("_r"))
    wanted = cut(wanted)
    # few texts take part in any pair; while they are few, theirs alone are looked up, and no text is shuffled
    wanted = F.broadcast(wanted) if bounded_collect(wanted.select("cls"), 100_000) is not None else wanted
    given = wanted.join(texts.select(F.col(key).cast("string").alias("_r"), "text").where("text is not null"), "_r").select("cls", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text is of their class; an id that stands with several texts brings others, too."""
        shingler = Shingler(width, least_words)
        for batch in batches:
            tokens = [shingler.tokens(t) for t in batch.column(1).to_pylist()]
            yield batch.filter(pa.array([t is not None and shingler.class_of(t) == c for t, c in zip(tokens, batch.column(0).to_pylist())], pa.bool_()))

    of = cut(given.mapInArrow(own, "cls long, text string").dropDuplicates(["cls"]))
    return verified(pairs, of, threshold, width, least_words), members.join(classes, "cls")


def found(chunks: DataFrame, threshold: float = 0.5, shown: int = 64) -> DataFrame:
    """``chunk_id_a, chunk_id_b``, a < b, of different chunks whose texts reach the threshold.

    Of a class of exact copies the first ``shown`` ids stand in pairs with one another and with those of the classes
    that it is linked to; each further copy is given by its link to the first, as ``groups`` gives all. No link between
    different texts is lost by that.
    """
    pairs, members = near_duplicates(chunks, threshold=threshold)
    members = cut(members)
    several = members.where("copies > 1")
    ranked = several.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy("chunk_id"))).select("cls", "chunk_id", "representative", "_n")
    first = members.where("copies = 1").select("cls", "chunk_id").unionByName(ranked.where(F.col("_n") <= shown).select("cls", "chunk_id"))
    x, y = first.select(F.col("cls").alias("a"), F.col("chunk_id").alias("x")), first.select(F.col("cls").alias("b"), F.col("chunk_id").alias("y"))
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    some = ranked.where(F.col("_n") <= shown).select("cls", "chunk_id")
    inside = some.withColumnRenamed("chunk_id", "x").join(some.withColumnRenamed("chunk_id", "y"), "cls").where("x < y").select("x", "y")
    more = ranked.where(F.col("_n") > shown).select(F.col("representative").alias("x"), F.col("chunk_id").alias("y"))
    return across.unionByName(inside).unionByName(more).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def pruning(chunks: DataFrame, threshold: float = 0.5, width: int = 3, least_words: int = 20, bands: int = 7, hot: int = 20_000, block: int = 10_000) -> DataFrame:
    """``level, pairs, dropped``: node pairs that the dual traversals compare and drop, leaves being level 0 and pairs of
    texts level -1."""
    reps = cut(signatures(chunks.where("chunk_id is not null and text is not null"), "chunk_id", width, least_words, bands).drop("chunk_id").dropDuplicates(["cls"]))
    return candidates(reps, threshold, hot, block, stats=True).groupBy("level").agg(F.sum("pairs").alias("pairs"), F.sum("dropped").alias("dropped"))


def groups(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each chunk that takes part: ``chunk_id, representative, copies, links``: the smallest id of its class,
    the class's size, and the other classes that the class is linked to."""
    pairs, members = near_duplicates(chunks, threshold=threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(links, "cls", "left").select("chunk_id", "representative", "copies", F.coalesce("links", F.lit(0)).alias("links"))
