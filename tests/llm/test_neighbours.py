import numpy as np
import pytest

from docloom.llm import neighbours as K


def data(seed, n, clusters, dims=64):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, dims))
    x = centres[r.integers(0, clusters, n)] + r.standard_normal((n, dims)) * r.choice([0.1, 0.3, 0.9], (n, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, k=5, radius=0.25):
    out = set()
    x = x.astype(np.float64)
    for i in range(len(ids)):
        d = ((x - x[i]) ** 2).sum(1)
        near = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out |= {tuple(sorted((ids[i], o))) for e, o in near if e <= radius}
    return out


def frame(spark, ids, x):
    rows = [(i, [float(v) for v in e], 1, "clash") for i, e in zip(ids, x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, t int, rank string").selectExpr("chunk_id", "embedding", "timestamp_seconds(t) AS embedded_at", "rank")


@pytest.mark.parametrize("cell", [6000, 150])
def test_recall_against_brute_force(spark, cell):
    x = data(1, 900, 60)
    ids = [f"v{i:04d}" for i in range(len(x))]
    want = brute(ids, x)
    out = K.neighbours(frame(spark, ids, x), cell=cell)
    got = {tuple(sorted((r.chunk_id, r.other_id))) for r in out.collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_dense_regions_get_more_cells():
    """A third of all vectors close to one place: no cell holds much more than its share, and the nearest cell is found."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((8000, 64)), r.standard_normal((1, 64)) + 0.02 * r.standard_normal((4000, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = K.Cells.fit(x, 100)
    near, gap = cells.visits(x, 3)
    assert np.bincount(near[:, 0]).max() <= 400 and (near[:, 0] >= 0).all() and (np.diff(gap, axis=1) >= 0).all()
    true = K.nearest(x, cells.centres)
    assert (near[:, 0] == true).mean() > 0.6 and (near == true[:, None]).any(1).mean() > 0.7
    one = K.Cells.fit(x[:1], 8)
    assert one.visits(x[:3], 3)[0].tolist() == [[0, -1, -1]] * 3


def test_bounds_hold():
    x = data(3, 400, 5)
    turn = K.rotation(64)
    c = x.mean(0)
    low, high = K.Codes(x[:300] - c, turn).bounds(x[300:] - c, turn)
    true = ((x[300:, None] - x[None, :300]) ** 2).sum(2)
    assert ((low <= true) & (true <= high)).mean() > 0.93


def test_cases(spark):
    e = lambda i: [1.0 if j == i else 0.0 for j in range(64)]
    rows = [("a", e(0), 1), ("a", e(1), 2), ("b", e(1), 1), ("c", [0.0] * 64, 1), ("d", [1.0], 1), ("e", None, 1), ("f", [None] * 64, 1), (None, e(1), 1), ("g", e(1), None), ("g", e(1), None), ("h", e(0), 1), ("h", None, 2)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, t int").selectExpr("chunk_id", "embedding", "timestamp_seconds(t) AS embedded_at")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in K.found(df).collect()} == {("a", "b"), ("a", "g"), ("b", "g")}
    assert K.found(df.limit(0)).count() == 0


def test_ties_and_many_copies(spark):
    e = [1.0] + [0.0] * 63
    near = [0.98, 0.199] + [0.0] * 62
    rows = [(f"c{i:02d}", e) for i in range(12)] + [("z", near)]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32)
    assert {(r.chunk_id_a, r.chunk_id_b) for r in K.found(frame(spark, ids, x)).collect()} == brute(ids, x)
