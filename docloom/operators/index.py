"""The retrieval index as tables: stored chunks, postings, corpus statistics, BM25 and nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded_collect, cut, wide_partitions

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query vectors that are sent to the tasks at once; more queries go in several such blocks.
QUERY_BLOCK = 4096
#: Bound on the query vectors of one call (64 numbers each: 100 MB on the driver).
MOST_QUERIES = 200_000
#: Queries whose words are matched at once in the word index: a matrix of their distinct words by queries (8 bytes each).
BM25_BLOCK = 512


def stored(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id with text; null ids and texts take no part. Repeated rows of a chunk carry the same text,
    so any of them stands for all."""
    rows = chunks.where("chunk_id is not null and text is not null")
    return rows.dropDuplicates(["chunk_id"])


def postings(corpus: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``<key>, token, tf, dl`` of every token of every text."""
    sized = corpus.select(key, tokens(F.col("text")).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return sized.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def token_lists(corpus: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``<key>, t``: the tokens of every text."""
    return corpus.select(key, tokens(F.col("text")).alias("t"))


def _stats(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))


def _frequencies(lists: DataFrame, epsilon: float) -> DataFrame:
    each = lists.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = each.join(F.broadcast(lists.agg(F.count("*").alias("n")))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: ``n`` texts and their mean length ``avgdl`` in tokens."""
    return _stats(corpus.select(tokens(F.col("text")).alias("t")))


def inverse_frequencies(corpus: DataFrame, key: str = "chunk_id", epsilon: float = EPSILON) -> DataFrame:
    """``token, df, idf`` of the whole corpus: ln(n - df + 0.5) - ln(df + 0.5), where negative ``epsilon`` times the mean."""
    return _frequencies(token_lists(corpus, key), epsilon)


def bm25(queries: DataFrame, corpus: DataFrame, key: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, <key>, score`` of all texts that share a token with a query.

    ``queries(query_id, text)``; tokens of a query count as often as they occur. Document frequencies are those of the
    whole corpus, but only postings of tokens that some query has are built.
    """
    asked = queries.where("text is not null").select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    terms = inverse_frequencies(corpus, key).join(asked.select("token").distinct(), "token", "left_semi")
    # tokens that no query has are dropped before anything is shuffled
    found = corpus.select(key, tokens(F.col("text")).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token")).join(terms, "token")
    scored = found.groupBy(key, "token", "dl", "idf").agg(F.count("*").alias("tf")).join(F.broadcast(corpus_stats(corpus)))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.select("token", key, weight.alias("w")).join(asked, "token").groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def top(scored: DataFrame, k: int, by: list[Column], partition: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition, numbered from 1."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(partition).orderBy(*by))).where(F.col(rank) <= k)


def bm25_top(queries: DataFrame, corpus: DataFrame, k: int = 24, key: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, <key>, score, rank``: the best texts of each query, ties by key; texts without a shared token are none.

    The same scores as ``bm25``. The queries are a stated set, sent in blocks against all texts; each batch of texts
    keeps its own ``k`` best of every query, so that common words, which nearly all texts share with nearly all queries,
    are never joined. More than ``MOST_QUERIES`` queries are an error; ask in several calls.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)[key]
    rows = bounded_collect(queries.where("query_id is not null and text is not null").select("query_id", tokens(F.col("text")).alias("t")), MOST_QUERIES)
    if rows is None:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    asked = sorted(((r.query_id, r.t) for r in rows if r.t), key=lambda r: r[0])
    words = sorted({w for _, t in asked for w in t})
    spark = corpus.sparkSession
    # one pass for all statistics: texts and their lengths are counted under the empty token
    each = token_lists(corpus, key).select(F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("token"), F.size("t").alias("dl"))
    counts = cut(each.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    total = counts.where("token = ''").first()
    n, avgdl = (total.df, total.dl / total.df or 1.0) if total else (0, 1.0)
    raw = counts.where("token <> ''").select("token", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    terms = spark.createDataFrame([(w,) for w in words], "token string")
    idf = {r.token: r.raw if r.raw >= 0 else EPSILON * mean for r in raw.join(terms, "token", "left_semi").collect()}
    sent = spark.sparkContext.broadcast((asked, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = sent.value
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            names, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in range(0, len(names), 512):
                some, here = found[s : s + 512], names[s : s + 512]
                for at in range(0, len(asked), BM25_BLOCK):
                    _score(asked[at : at + BM25_BLOCK], idf, some, here, best[at : at + BM25_BLOCK], k, k1, b, avgdl)
        out = [(asked[j][0], name, float(score)) for j, found in enumerate(best) for _, name, score in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (batch_type(kinds[0]), batch_type(kinds[1]), pa.float64()))], names=["query_id", key, "score"])

    scored = token_lists(corpus, key).mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    return top(scored, k, [F.round("score", 9).desc(), F.col(key)])


def _score(block: list[tuple], idf: dict[str, float], texts: list[list[str]], names: list, best: list[list[tuple]], k: int, k1: float, b: float, avgdl: float) -> None:
    """Keeps in ``best``, for each query of a block, the ``k`` best of some texts and of those before."""
    column = {w: i for i, w in enumerate(sorted({w for _, t in block for w in t if w in idf}))}
    times = np.zeros((len(column), len(block)))
    for j, (_, t) in enumerate(block):
        for w in t:
            if w in column:
                times[column[w], j] += 1
    weight = np.array([idf[w] for w in column])
    tf, dl = np.zeros((len(texts), len(column))), np.array([len(t) for t in texts], np.float64)
    for r, t in enumerate(texts):
        for w in t:
            if (c := column.get(w)) is not None:
                tf[r, c] += 1
    part = np.divide(tf * (k1 + 1), tf + (k1 * (1 - b + b * dl / avgdl))[:, None])
    raw = (part * weight) @ times
    scores = np.round(raw, 9)
    common = (tf > 0).astype(np.float32) @ (times > 0).astype(np.float32) > 0
    scores[~common] = -np.inf
    least = -np.sort(-scores, axis=0)[min(k, len(texts)) - 1]
    for j in range(len(block)):
        near = np.flatnonzero(common[:, j] & (scores[:, j] >= least[j]))
        if len(near):
            best[j][:] = sorted([*best[j], *((-scores[r, j], names[r], raw[r, j]) for r in near)])[:k]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, key: str, exclude_same: bool = False) -> DataFrame:
    """``<query_id>, <key>, distance, rank``: the ``k`` nearest vectors of each query by squared distance, ties by key.

    ``queries(<query_id>, embedding)`` are a stated set, sent in blocks against all of ``vectors(<key>, embedding)``;
    each task keeps its own ``k`` nearest of every query, and only those are shuffled. Vectors of another length than
    the query's are passed over. More than ``MOST_QUERIES`` queries are an error; ask in several calls.
    """
    rows = bounded_collect(queries.where(f"{query_id} is not null and embedding is not null").select(query_id, "embedding"), MOST_QUERIES)
    if rows is None:
        raise ValueError(f"more than {MOST_QUERIES} query vectors")
    asked = sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0])
    kinds = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[key]
    schema = f"{query_id} {kinds[0]}, {key} {kinds[1]}, distance double"
    parts = []
    for at in range(0, max(len(asked), 1), QUERY_BLOCK):
        block = asked[at : at + QUERY_BLOCK]
        sent = vectors.sparkSession.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], np.float64) if block else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                values = batch.column(1).to_pylist()
                ok = [i for i, v in enumerate(values) if v is not None and len(v) == q.shape[1]]
                out_q, out_k, out_d = [], [], []
                if ok and len(q):
                    x = np.array([values[i] for i in ok], np.float64)
                    names = keys[ok]
                    near = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
                    take = min(k + 2, near.shape[1])
                    best = np.argpartition(near, take - 1, axis=1)[:, :take]
                    edge = np.take_along_axis(near, best, 1).max(1) + 1e-9
                    for r in range(len(q)):
                        some = np.flatnonzero(near[r] <= edge[r])  # with all ties of the last
                        if exclude_same:
                            some = some[names[some] != ids[r]]
                        d = ((x[some] - q[r]) ** 2).sum(1)
                        order = sorted(range(len(some)), key=lambda i: (d[i], names[some[i]]))[:k]
                        out_q += [ids[r]] * len(order)
                        out_k += [names[some[i]] for i in order]
                        out_d += [float(d[i]) for i in order]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, batch_type(kinds[0])), pa.array(out_k, batch_type(kinds[1])), pa.array(out_d, pa.float64())], names=[query_id, key, "distance"])

        parts.append(vectors.where(f"{key} is not null").select(key, "embedding").mapInArrow(run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, k, [F.col("distance"), F.col(key)], query_id)


def batch_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def build(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The stored index: chunk columns, their vector and ``pos``, the place in index order (source, chunk id).

    Chunks and vectors are aligned one to one by id; chunks without a vector and vectors without a chunk are left out.
    Rows are sorted in ranges of (source, chunk id); ``pos`` is a row's place in its range behind the ranges before, so
    that no task orders the whole index or a whole source.
    """
    rows = stored(chunks).join(vectors.where("embedding is not null").dropDuplicates(["chunk_id"]).select("chunk_id", "embedding"), "chunk_id")
    placed = cut(rows.repartitionByRange(wide_partitions(rows), "source_name", "chunk_id").sortWithinPartitions("source_name", "chunk_id").withColumn("_id", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("n"))  # one row a range
    before = ranges.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(before), "_range").withColumn("pos", F.col("_before") + inside).drop("_id", "_range", "_before")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``sha, text`` of texts that must still be embedded: distinct by hash, of chunks that have no vector."""
    todo = stored(chunks).join(vectors.where("embedding is not null").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return todo.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text").dropDuplicates(["sha"])


PROBES = ("summary overview introduction key topics main points", "document text content sections paragraphs")


def probe(probes: DataFrame, vectors: DataFrame, key: str = "chunk_id", limit: float = 1.48, least: int = 3) -> DataFrame:
    """One row ``ok, best_distance, message``: whether the index of ``vectors(<key>, embedding)`` answers at all.

    The least distance of the best hits of ``probes(probe, embedding)``, such as the embedded ``PROBES``, must be at most
    ``limit``. An empty index fails (``empty_index``); one of fewer than ``least`` vectors is passed unseen
    (``tiny_index_skipped``).
    """
    n = vectors.where("embedding is not null").agg(F.count("*").alias("n"))
    best = nearest(probes, vectors, least, "probe", key).agg(F.min("distance").alias("d"))
    message = F.when(F.col("n") == 0, "empty_index").when(F.col("n") < least, "tiny_index_skipped").when(F.col("d").isNull(), "probe_failed").when(F.col("d") <= limit, "ok").otherwise("weak_best_hit")
    return n.join(F.broadcast(best)).select(message.isin("ok", "tiny_index_skipped").alias("ok"), F.when(F.col("n") >= least, F.round("d", 6)).alias("best_distance"), message.alias("message"))


__all__ = ["bm25", "bm25_top", "build", "corpus_stats", "inverse_frequencies", "missing_vectors", "nearest", "postings", "probe", "stored", "top"]
