import random

from pyspark.sql import functions as F

from docloom.llm import conversations as C

MSG = "id long, session_id string, role string, content string, extra_json string, speaker string, root long"
SES = "id string, title string, session_id string"


def found(spark, messages, sessions, **kw):
    m = spark.createDataFrame([(*r, None, "clash", 7) for r in messages], MSG)
    s = spark.createDataFrame([(x, None, "clash") for x in sessions], SES)
    return {(r.session_id, r.defect) for r in C.defects(C.rebuild(m, **kw), s).collect()}


def test_defects(spark):
    messages = [
        (1, " A ", "user", "q"), (2, "a", "Assistant ", "r"), (3, "b", "human", "q"), (4, "b", "bot", " \n"), (5, "c", "assistant", "r"), (6, "d", "user", "q"), (7, "d", "user", "q"), (8, "d", "ai", "r"),
        (9, "e", "user", "q"), (10, "e", "tool", "x"), (11, "e", "assistant", "r"), (12, "f", "system", "s"), (13, "g", "user", None), (14, "h", "user", "q"), (15, "h", "assistant", "r"), (16, "h", "assistant", "r2"), (17, None, "user", "q"), (None, "a", "user", "q"), (2, "a", "Assistant ", "r"),
    ]
    got = found(spark, messages, ["A", "b", "c", "d", "e", "f", "g", "h ", "i", None])
    assert got == {("b", "missing_reply"), ("c", "broken"), ("e", "broken"), ("f", "empty"), ("g", "empty"), ("h", "broken"), ("i", "empty")}
    assert ("a", "broken") in found(spark, messages, [])


def test_blocks_make_no_difference(spark):
    r = random.Random(3)
    messages = [(i, r.choice("ab"), r.choice(["user", "assistant", "user", "assistant", "system", "x"]), r.choice(["q", "r", ""])) for i in r.sample(range(200), 150)]
    assert found(spark, messages, ["a"], block=7) == found(spark, messages, ["a"])


def test_pointer_jumping(spark):
    chain = [(i, i - 1 if i else None) for i in range(100)]
    extra = [(200, 201), (201, 200), (202, 201), (300, 999), (301, 300), (400, 400)]
    got = {r.id: (r.root, r.depth, r.state) for r in C.resolve(spark.createDataFrame([*chain, *extra], "id long, parent long")).collect()}
    assert all(got[i] == (0, i, "ok") for i in range(100))
    assert got[300] == (300, 0, "orphan") and got[301] == (300, 1, "orphan")
    assert {got[i] for i in (200, 201, 202, 400)} == {(None, None, "cycle")}


def test_tree_of_given_parents(spark):
    rows = [(1, "a", "user", "q", None), (2, "a", "assistant", "r", 1), (3, "a", "assistant", "other", 1), (4, "a", "user", "q2", 3)]
    nodes = C.rebuild(spark.createDataFrame(rows, "id long, session_id string, role string, content string, up long"), parent="up")
    assert {r.id: r.depth for r in nodes.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_conversations_are_ordered(spark):
    rows = [(5, "a", "user", "q2"), (1, "a", "user", "q"), (2, "a", "assistant", "r"), (9, "a", "assistant", "r2"), (3, "b", "assistant", "x")]
    out = C.conversations(spark.createDataFrame(rows, "id long, session_id string, role string, content string"), spark.createDataFrame([("a",), ("b",)], "id string")).orderBy("turn").collect()
    assert [r.content for r in out] == ["q", "r", "q2", "r2"] and {r.turns for r in out} == {4}


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], ["a"]) == {("a", "empty")}
    assert C.resolve(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_speaker(spark):
    df = spark.createDataFrame([(" USER\n",), ("Human",), ("bot",), (None,), ("",)], "r string")
    assert [r.s for r in df.select(C.speaker(F.col("r")).alias("s")).collect()] == ["user", "user", "assistant", "other", "other"]


def test_every_row_jumps(spark, monkeypatch):
    """Pointers that come from the order are resolved row by row, and what comes of that decides on defects."""
    rows = [(i, "a", "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 9)] + [(20, "b", "user", "q"), (21, "b", "bot", "r")]
    seen, own = [], C.resolve
    monkeypatch.setattr(C, "resolve", lambda links: seen.append({(r.id, r.parent) for r in links.collect()}) or own(links))
    assert found(spark, rows, ["a", "b"]) == set()
    assert seen == [{(1, None), *((i, i - 1) for i in range(2, 9)), (20, None), (21, 20)}]
    monkeypatch.setattr(C, "resolve", lambda links: own(links).withColumn("state", F.expr("if(id = 5, 'cycle', state)")))
    assert found(spark, rows, ["a", "b"]) == {("a", "broken")}


def test_conversations_are_paths(spark):
    rows = [(1, "a", "user", "q", None), (2, "a", "assistant", "r", 1), (3, "a", "assistant", "other", 1), (4, "a", "user", "q2", 3), (5, "a", "assistant", "r2", 4)]
    m = spark.createDataFrame(rows, "id long, session_id string, role string, content string, up long")
    out = C.conversations(m, spark.createDataFrame([("a",)], "id string"), parent="up").collect()
    assert sorted((r.turns, r.turn, r.content) for r in out) == [(2, 0, "q"), (2, 1, "r"), (4, 0, "q"), (4, 1, "other"), (4, 2, "q2"), (4, 3, "r2")]
