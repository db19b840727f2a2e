import random
import re

import numpy as np
import pytest

from docloom.llm import neardup as N


def shingles(text, width=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(*(w[i:] for i in range(width)))) if len(w) >= 20 else None


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(25, 90))] for _ in range(n // 4)]
    out = {}
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 6])):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.2:
            k = r.randrange(len(t))
            t = t[k:] + t[:k]
        out[f"c{i:03d}"] = " ".join(t)
    return out


def brute(texts, threshold=0.5):
    sets = {k: s for k, t in texts.items() if (s := shingles(t))}
    ks = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [4000, 3])
def test_found_matches_brute_force(spark, hot, monkeypatch):
    texts = corpus(5)
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "chunk_id string, text string, cls string")
    if hot != 4000:
        monkeypatch.setattr(N, "SAMPLED", 1)
        original = N.near_duplicates
        monkeypatch.setattr(N, "near_duplicates", lambda c, **kw: original(c, hot=hot, block=4, **kw))
    got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found(df).collect()}
    want = brute(texts)
    assert not got - set(want)
    assert not {p for p, s in want.items() if s >= 0.6} - got
    assert len(got) >= 0.97 * len(want)


def test_hot_subtrees_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLED", 1)
    r, words = random.Random(7), [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    texts = [" ".join(r.choice(words) if r.random() < 0.12 else w for w in base) for _ in range(60)]  # one family around the threshold
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    reps = N.signatures(df, "chunk_id", 3, 20, 14).drop("chunk_id").dropDuplicates(["cls"]).cache()
    whole, divided = ({tuple(r) for r in N.candidates(reps, 0.5, hot, 4).collect()} for hot in (4000, 3))
    assert whole and divided == whole


def test_traversal_loses_no_pair():
    r = np.random.default_rng(2)
    for size in (5, 60, 300):
        sets = [set(r.choice(60, r.integers(5, 25), replace=False).tolist()) for _ in range(size)]
        sets.sort(key=len)
        bits = np.zeros((size, 256), np.uint8)
        for i, s in enumerate(sets):
            bits[i, list(s)] = 1
        packed, n = np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.array([len(s) for s in sets])
        i, j = N.traverse((packed, n), None, 0.5)
        got = set(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a in range(size) for b in range(a + 1, size) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
        assert want <= got
        half = size // 2
        i, j = N.traverse((packed[:half], n[:half]), (packed[half:], n[half:]), 0.5)
        assert {(a, b) for a, b in want if a < half <= b} <= {(a, b + half) for a, b in zip(i.tolist(), j.tolist())}


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(30))
    rows = [("a", long), ("b", long.upper()), ("b", long.upper()), ("c", None), ("d", ""), ("e", "too short"), (None, long), ("f", " ".join(f"z{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in N.found(df).collect()} == {("a", "b")}
    assert {(r.chunk_id, r.copies, r.links) for r in N.groups(df).collect()} == {("a", 2, 0), ("b", 2, 0), ("f", 1, 0)}
    assert N.found(df.limit(0)).count() == 0


def test_copies_beyond_the_shown_ones_are_linked(spark):
    long = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(f"c{i}", long) for i in range(9)] + [("d", long + " one more")], "chunk_id string, text string")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found(df, shown=4).collect()}
    first = [f"c{i}" for i in range(4)]
    assert got == {(a, b) for a in first for b in first if a < b} | {(a, "d") for a in first} | {("c0", f"c{i}") for i in range(4, 9)}
    assert {(r.chunk_id, r.copies, r.links) for r in N.groups(df).collect()} == {(f"c{i}", 9, 1) for i in range(9)} | {("d", 1, 1)}


def test_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [("a", one), ("a", two), ("a", "too short"), ("b", one + " end"), ("c", two + " end")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert len({(r.chunk_id_a, r.chunk_id_b) for r in N.found(df).collect()} & {("a", "b"), ("a", "c")}) == 1


def test_trees_drop_most_node_pairs(spark):
    """Texts that share an opening, and so a node, but little else."""
    r, words = random.Random(9), [f"w{i}" for i in range(5000)]
    start = " ".join(words[:12])
    texts = [(f"c{i:04d}", start + " " + " ".join(r.choice(words) for _ in range(90))) for i in range(4000)]
    out = {x.level: x for x in N.pruning(spark.createDataFrame(texts, "chunk_id string, text string")).collect()}
    pairs, dropped = (sum(x[c] for k, x in out.items() if k >= 0) for c in ("pairs", "dropped"))
    assert dropped > 0.9 * pairs
    assert N.pruning(spark.createDataFrame(texts[:200], "chunk_id string, text string"), hot=3, block=8).where("pairs >= dropped").count() > 0
