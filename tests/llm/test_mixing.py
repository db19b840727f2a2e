import pytest

from docloom.llm import mixing as M
from docloom.llm import tokens


def frames(spark, docs, targets):
    d = spark.createDataFrame([(i, t, l, s, 1) for i, t, l, s in docs], "doc_id long, text string, lang string, source string, tokens int")
    return d, spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")


DOCS = [(i, "one two three four five six seven eight. " * 3, "en", " Big") for i in range(200)] + [(1000 + i, "one two three four. " * 3, "de", "small") for i in range(10)] + [(2000, None, None, "small"), (2001, "", "en", "big"), (2002, "other", "en", "elsewhere"), (2003, "x", "en", None), (1000, "one two three four. " * 3, "de", "small")]


def test_shares_and_shortage(spark):
    d, t = frames(spark, DOCS, [("BIG ", 0.5, 1), ("small", 0.5, 3), ("missing", 0.0, 1), (None, 0.1, 1)])
    report = {r.source: r for r in M.report(d, t).collect()}
    assert {s for s, r in report.items() if r.short} == {"small"}
    assert {r.source for r in M.found(d, t).collect()} == {"small"}
    out = M.mix(d, t).collect()
    use = {}
    for r in out:
        use[r.doc_id] = use.get(r.doc_id, 0) + 1
    assert max(v for k, v in use.items() if k < 200) == 1 and {v for k, v in use.items() if 1000 <= k < 1010} == {3}
    shares = {r.source: r for r in M.shares(d, t).collect()}
    assert shares["missing"].tokens == 0 and shares["small"].most_used == 3
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted((r.doc_id, r.epoch) for r in M.mix(d, t).collect())


def test_prefix_meets_budget(spark):
    d, t = frames(spark, DOCS, [("big", 0.3, 1), ("small", 0.7, 1)])
    spent = {r.source: r.tokens for r in M.shares(d, t).collect()}
    for r in M.report(d, t).collect():
        assert r.budget <= spent[r.source] + 1 and spent[r.source] <= r.budget + 60


def test_budget_goes_to_siblings_first(spark):
    tree = spark.createDataFrame([("d", "x", "a", 0.25, 10.0), ("d", "x", "b", 0.25, 100.0), ("d", "y", "a", 0.5, 1000.0)], "domain string, lang string, source string, weight double, capacity double")
    of = lambda total: {(r.lang, r.source): r.budget for r in M.budgets(tree, total).collect()}
    assert of(100) == pytest.approx({("x", "a"): 10, ("x", "b"): 40, ("y", "a"): 50})  # flat sharing would give y more
    assert of(2000) == pytest.approx({("x", "a"): 10, ("x", "b"): 100, ("y", "a"): 1000})
    assert of(0) == pytest.approx({("x", "a"): 0, ("x", "b"): 0, ("y", "a"): 0})


def test_fill_against_rounds(spark):
    import random

    r = random.Random(4)
    rows = [(f, i, r.choice([0.0, r.random()]), r.choice([0.0, r.uniform(0, 50)]), float(40 * f)) for f in range(1, 8) for i in range(9)]
    out = M.fill(spark.createDataFrame(rows, "f int, i int, weight double, capacity double, amount double"), ["f"]).collect()
    for f in range(1, 8):
        own = {i: [w, c, 0.0] for g, i, w, c, _ in rows if g == f}
        rest = 40.0 * f
        for _ in range(500):  # give by weight, take back what does not fit, again
            free = {i: n for i, n in own.items() if n[0] > 0 and n[2] < n[1] - 1e-9}
            if not free or rest < 1e-9:
                break
            each, rest = rest / sum(n[0] for n in free.values()), 0.0
            for n in free.values():
                took = min(each * n[0], n[1] - n[2])
                rest += each * n[0] - took
                n[2] += took
        assert {x.i: x.budget for x in out if x.f == f} == pytest.approx({i: n[2] for i, n in own.items()}, abs=1e-6)


def test_languages_without_bound(spark):
    docs = [(i, "one two three", f"language {i}", "big") for i in range(300)]
    d, t = frames(spark, docs, [("big", 1.0, 2)])
    assert M.mix(d, t).select("doc_id").distinct().count() == 300


def test_empty(spark):
    d, t = frames(spark, DOCS, [("big", 1.0, 1)])
    assert M.mix(d.limit(0), t).count() == 0 and M.mix(d, t.limit(0)).count() == 0 and M.report(d, t.limit(0)).count() == 0


def test_tokens_of_long_texts():
    t = tokens.encoder()
    text = "some words here " * 20_000
    assert abs(sum(len(t.encode_ordinary(p)) for p in tokens._runs(text)) - len(t.encode_ordinary(text))) <= 8
