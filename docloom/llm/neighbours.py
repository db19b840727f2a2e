"""The nearest vectors of every vector by randomly rotated one-bit codes.

Coarse cells come from a bounded sample that is parted by k-means again and again until no part holds much more than its
share, so that a dense region gets as many cells as it has vectors for; the cells' centroids are grouped in turn, and a
vector is compared only with the cells of its nearest groups. Every vector is indexed in its nearest cell and asks there
and in the cells that are nearly as close. Within a cell, vectors lie in short lists around local centroids. A vector's
residual to its list's centroid is rotated at random and kept as one bit for each dimension, with two correction
scalars: its length and its inner product with its code. A query's residual is rotated alike and rounded to four bits;
popcounts of the packed bits then give an estimate of the inner product with a bound on its error. Only vectors whose
lower bound on the distance is within the radius, and within the k-th smallest upper bound, are reranked exactly, in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_collect, cut, kept as held

#: Vectors that a cell should hold, sampled vectors for each cell, and the bound on the sample that the cells are fitted on.
CELL, SAMPLE_FOR_CELL, MOST_SAMPLE = 6000, 40, 200_000
#: Parts of one split, rows compared with centroids at once, and groups of cells that a vector looks into.
PARTS, ROWS, GROUPS = 32, 4096, 4
LIST = 96
EPSILON = 1.9


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid; only ``ROWS`` rows of distances are held at once."""
    norms, out = (c * c).sum(1)[None, :], np.empty(len(x), np.int64)
    for s in range(0, len(x), ROWS):
        out[s : s + ROWS] = (norms - 2 * (x[s : s + ROWS] @ c.T)).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centroids of ``x``; empty ones are put onto rows far from their centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        if len(some) < k:
            far = np.argsort(-((x - c[at]) ** 2).sum(1), kind="stable")[: k - len(some)]
            c[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return c


class Cells:
    """Centroids of cells in groups of near ones."""

    def __init__(self, centres: np.ndarray, seed: int = 31):
        heads = kmeans(centres, max(1, round(len(centres) ** 0.5)), seed, 8)
        of = nearest(centres, heads)
        some = np.unique(of)
        self.heads, order = heads[some], np.argsort(of, kind="stable")
        self.centres, of = centres[order], np.searchsorted(some, of[order])
        self.edges = np.searchsorted(of, np.arange(len(some) + 1))

    @classmethod
    def fit(cls, sample: np.ndarray, each: int, seed: int = 23) -> Cells:
        """Cells of about ``each`` sampled rows."""
        leaves, todo = [], [np.arange(len(sample))]
        while todo:
            rows = todo.pop()
            own = sample[rows]
            if len(rows) > 1.5 * each:
                c = kmeans(own, min(PARTS, -(-len(rows) // each)), seed)
                at = nearest(own, c)
                order = np.argsort(at, kind="stable")
                parts = [p for p in np.split(rows[order], np.searchsorted(at[order], np.arange(1, len(c)))) if len(p)]
                if len(parts) > 1:
                    todo += parts
                    continue
            leaves.append(own.mean(0))
        cells = cls(np.array(leaves, np.float32))
        for _ in range(3):
            at = cells.visits(sample, 1)[0][:, 0]
            order = np.argsort(at, kind="stable")
            n = np.bincount(at, minlength=len(cells.centres))
            some = np.flatnonzero(n)
            cells = cls((np.add.reduceat(sample[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]).astype(np.float32))
        return cells

    def visits(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row its ``most`` nearest cells among those of its nearest groups, nearest first, and their squared
        distances less the row's own square; -1 and infinity where there are fewer."""
        wide = min(GROUPS, len(self.heads))
        cells, gaps = np.full((len(x), wide, most), -1, np.int64), np.full((len(x), wide, most), np.inf, np.float32)
        for s in range(0, len(x), ROWS):
            part = x[s : s + ROWS]
            d = (self.heads * self.heads).sum(1)[None, :] - 2 * (part @ self.heads.T)
            near = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < d.shape[1] else np.tile(np.arange(wide), (len(part), 1))
            for g in np.unique(near):
                rows, slot = np.nonzero(near == g)
                a, b = self.edges[g], self.edges[g + 1]
                c = self.centres[a:b]
                own = (c * c).sum(1)[None, :] - 2 * (part[rows] @ c.T)
                k = min(most, b - a)
                best = np.argpartition(own, k - 1, axis=1)[:, :k] if k < b - a else np.tile(np.arange(k), (len(rows), 1))
                cells[s + rows, slot, :k], gaps[s + rows, slot, :k] = best + a, np.take_along_axis(own, best, 1)
        cells, gaps = cells.reshape(len(x), -1), gaps.reshape(len(x), -1)
        order = np.argsort(gaps, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cells, order, 1), np.take_along_axis(gaps, order, 1)


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(97).standard_normal((dims, dims)))[0].astype(np.float32)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of the residuals ``r`` (rows) under the rotation ``turn``."""

    def __init__(self, r: np.ndarray, turn: np.ndarray):
        self.dims = r.shape[1]
        self.length = np.sqrt((r * r).sum(1))
        unit = (r / np.maximum(self.length, 1e-12)[:, None]) @ turn
        self.bits = pack(unit > 0)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.float32)
        self.own = np.maximum(np.abs(unit).sum(1) / np.sqrt(self.dims), 1e-6)

    def bounds(self, q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds on the squared distances of query residuals ``q`` (rows) to the coded vectors (columns)."""
        length = np.sqrt((q * q).sum(1))
        unit = (q / np.maximum(length, 1e-12)[:, None]) @ turn
        low = unit.min(1)
        step = np.maximum((unit.max(1) - low) / 15, 1e-12)
        whole = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
        dot = np.zeros((len(q), len(self.bits)), np.float32)
        for b in range(4):
            plane = pack((whole >> b) & 1)
            for w in range(plane.shape[1]):
                dot += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(np.float32) * (1 << b)
        root = np.sqrt(self.dims)
        inner = (2 * step[:, None] * dot + 2 * low[:, None] * self.ones[None, :] - (step * whole.sum(1) + self.dims * low)[:, None]) / root
        estimate = inner / self.own[None, :]
        error = np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own * EPSILON / np.sqrt(self.dims - 1) + 1e-3
        both = 2 * length[:, None] * self.length[None, :]
        middle = (length**2)[:, None] + (self.length**2)[None, :] - both * estimate
        slack = both * error[None, :]
        return middle - slack, middle + slack


def search(x: np.ndarray, home: np.ndarray, ids: list[str], k: int, radius: float, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` its ``k`` nearest among the rows marked ``home``: row numbers, others, squared distances.

    Ties go to the smaller id. Rows beyond ``radius`` (squared) are left out.
    """
    turn = rotation(x.shape[1])
    own = np.flatnonzero(home)
    if not len(own) or len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lists = max(1, len(own) // LIST)
    sample = own if len(own) <= 20 * lists else np.random.default_rng(5).choice(own, 20 * lists, replace=False)
    c = kmeans(x[sample], lists, 11)
    near = np.empty((len(x), min(probes, len(c))), np.int64)
    gap = np.empty(near.shape, np.float32)
    for s in range(0, len(x), 2048):
        d = (c * c).sum(1)[None, :] - 2 * (x[s : s + 2048] @ c.T)
        p = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        g = np.take_along_axis(d, p, 1)
        o = np.argsort(g, axis=1)
        near[s : s + 2048], gap[s : s + 2048] = np.take_along_axis(p, o, 1), np.take_along_axis(g, o, 1)
    asked = gap <= gap[:, :1] + margin
    rows, cols = np.nonzero(asked)
    by = np.argsort(near[rows, cols], kind="stable")
    ask_list, ask_row = near[rows, cols][by], rows[by]
    in_list = near[own, 0]
    put = np.argsort(in_list, kind="stable")
    stored, stored_list = own[put], in_list[put]
    edges = np.arange(len(c) + 1)
    qa, ia = np.searchsorted(ask_list, edges), np.searchsorted(stored_list, edges)
    rank = np.empty(len(ids), np.int64)
    rank[np.array(sorted(range(len(ids)), key=ids.__getitem__))] = np.arange(len(ids))
    found = []
    for i in range(len(c)):
        members, queries = stored[ia[i] : ia[i + 1]], ask_row[qa[i] : qa[i + 1]]
        if not len(members) or not len(queries):
            continue
        codes = Codes(x[members] - c[i], turn)
        for s in range(0, len(queries), 1024):
            q = queries[s : s + 1024]
            lower, upper = codes.bounds(x[q] - c[i], turn)
            reach = np.full(len(q), radius, np.float32)
            if len(members) > k + 1:
                reach = np.minimum(reach, np.partition(upper, k, axis=1)[:, k])  # one of them may be the query
            a, b = np.nonzero(lower <= reach[:, None])
            a, b = q[a], members[b]
            keep = a != b
            a, b = a[keep], b[keep]
            d = ((x[a].astype(np.float64) - x[b].astype(np.float64)) ** 2).sum(1)
            near_enough = d <= radius
            # no more than k of a list can be among the k nearest, so a dense region keeps no more either
            found.append(_best(a[near_enough], b[near_enough], d[near_enough], rank, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _best(*(np.concatenate(v) for v in zip(*found)), rank, k)


def _best(a: np.ndarray, b: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (row, other, distance) the ``k`` nearest others of each row, ties by ``rank``."""
    order = np.lexsort((rank[b], d, a))
    a, b, d = a[order], b[order], d[order]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[top], b[top], d[top]


def latest(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """``chunk_id, embedding``: every chunk's latest vector if it has ``dims`` numbers, none null, and is not all zero."""
    of = vectors.where("chunk_id is not null").groupBy("chunk_id").agg(
        F.max_by(F.struct("embedding"), F.struct(F.coalesce("embedded_at", F.timestamp_seconds(F.lit(0))), F.xxhash64("embedding"))).alias("v")
    )
    ok = (F.size("v.embedding") == dims) & F.forall("v.embedding", lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists("v.embedding", lambda e: e != 0)
    return of.where(F.col("v.embedding").isNotNull() & ok).select("chunk_id", F.col("v.embedding").cast("array<float>").alias("embedding"))


def neighbours(vectors: DataFrame, k: int = 5, radius: float = 0.25, dims: int = 64, cell: int = CELL, margin: float = 0.08, visits: int = 3, probes: int = 8, reach: float = 0.22) -> DataFrame:
    """``chunk_id, other_id, rank, distance``: up to ``k`` nearest others of each chunk within ``radius`` (squared).

    ``vectors`` needs ``chunk_id, embedding, embedded_at``; see ``latest`` for what takes part. Ties go to the smaller
    id. Of more than k + 1 equal vectors the k + 1 smallest ids stand for all: the others find those k and are found by
    none, as the order asks. A vector asks in up to ``visits`` cells (``probes`` lists) whose squared distance is
    within ``margin`` (``reach``) of its nearest; recall is measured in the tests. Empty input gives no rows.
    """
    have = held(latest(vectors, dims).withColumn("same", F.xxhash64("embedding")))
    copies = cut(have.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("same"))
    repeated = None
    kept = have
    if not copies.isEmpty():
        small = (lambda df: F.broadcast(df)) if bounded_collect(copies, 20_000) is not None else (lambda df: df)
        many = have.select("same", "chunk_id").join(small(copies), "same", "left_semi")
        first = cut(many.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("chunk_id"))).where(F.col("r") <= k + 1))
        by = have.join(small(copies.withColumn("many", F.lit(True))), "same", "left").join(small(first.select("chunk_id", F.lit(True).alias("first"))), "chunk_id", "left")
        kept = by.where("many is null or first").select(*have.columns)
        to = first.where(F.col("r") <= k).select("same", F.col("chunk_id").alias("other_id"), F.col("r").alias("rank"))
        repeated = many.join(small(first.select("chunk_id")), "chunk_id", "left_anti").join(small(to), "same").select("chunk_id", "other_id", "rank", F.lit(0.0).alias("distance"))
    spark = vectors.sparkSession
    n = kept.count()
    cells = max(1, round(n / cell))
    share = min(1.0, min(MOST_SAMPLE, max(2000, SAMPLE_FOR_CELL * cells)) / max(n, 1))
    picked = kept.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("embedding").limit(MOST_SAMPLE).toArrow()
    flat = np.asarray(picked["embedding"].combine_chunks().flatten()) if picked.num_rows else np.zeros(0, np.float32)
    flat = flat.reshape(-1, dims).astype(np.float32)
    sent = spark.sparkContext.broadcast(Cells.fit(flat, max(8, round(len(flat) / cells))) if len(flat) else Cells(np.zeros((1, dims), np.float32)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, gap = sent.value.visits(np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, dims), visits)
            row, col = np.nonzero(gap <= gap[:, :1] + margin)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), pa.array(col == 0), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "home", "chunk_id", "embedding"])

    def inside(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = np.asarray(group["embedding"].combine_chunks().flatten(), np.float32).reshape(-1, dims)
        ids = group["chunk_id"].to_pylist()
        a, b, d = search(x, group["home"].to_numpy(zero_copy_only=False).astype(bool), ids, k, radius, probes, reach)
        names = group["chunk_id"].combine_chunks()
        return pa.table({"chunk_id": names.take(pa.array(a)), "other_id": names.take(pa.array(b)), "distance": d})

    placed = kept.select("chunk_id", "embedding").mapInArrow(assign, "cell int, home boolean, chunk_id string, embedding array<float>")
    parts = min(4 * len(sent.value.centres), 20_000)
    hits = placed.repartition(parts, "cell").groupBy("cell").applyInArrow(inside, "chunk_id string, other_id string, distance double")
    # a pair that one side alone came upon counts for both
    both = hits.select(F.explode(F.array(F.struct("chunk_id", "other_id", "distance"), F.struct(F.col("other_id").alias("chunk_id"), F.col("chunk_id").alias("other_id"), "distance"))).alias("h")).select("h.*")
    rank = F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("distance", "other_id"))
    out = both.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["chunk_id", "other_id"]).select("chunk_id", "other_id", "rank", "distance")
    return out if repeated is None else out.unionByName(repeated)


def found(vectors: DataFrame) -> DataFrame:
    """``chunk_id_a, chunk_id_b``, a < b, of near neighbours."""
    return neighbours(vectors).select(F.least("chunk_id", "other_id").alias("chunk_id_a"), F.greatest("chunk_id", "other_id").alias("chunk_id_b")).distinct()
