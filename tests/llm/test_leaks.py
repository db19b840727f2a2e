from docloom.llm import leaks as L

ITEM = "When Orvane Foods stored 45 parcels in March the night shift asked every harbour lead to move the ledger."


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, query string")
    return {(r.doc_id, r.item_id): (r.literal_windows, r.template_windows) for r in L.leaks(d, e, **kw).collect()}


def test_literal_and_template(spark):
    docs = [
        (1, "Note: " + ITEM.upper().replace(" ", "\n ")), (2, ITEM.replace("45", "91").replace("March", "June").replace("Orvane", "Zebulon")), (3, "When Orvane Foods stored 45 parcels in March the night shift"), (4, None), (5, ""), (1, ITEM),
        (6, "asked every harbour lead to move the ledger"), (7, "x " * 5000 + ITEM), (8, ITEM.replace("parcels", "wagons").replace("shift", "owl")),
    ]
    got = run(spark, docs, [(10, ITEM), (11, None), (12, "short"), (10, ITEM)])  # no item holds the new name
    assert (8, 10) not in got
    assert got[1, 10][0] > 0 and got[7, 10] == (got[1, 10][0], 0)
    assert (3, 10) not in got and (6, 10) not in got
    assert got[2, 10][0] == 0 and got[2, 10][1] > 0


def test_empty(spark):
    assert run(spark, [], [(10, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_number_tables_are_no_template(spark):
    row = lambda k: " ".join(str(k * i) for i in range(1, 30))
    got = run(spark, [(i, row(i)) for i in range(2, 40)], [(10, row(3))])
    assert set(got) == {(3, 10)}  # the one with the very numbers


def test_many_documents_with_one_passage(spark):
    got = run(spark, [(i, f"{i} {ITEM}") for i in range(400)], [(10, ITEM)])
    assert len(got) == 400


def test_slots_must_agree():
    ordinary = L.Marked({"x"}, 12)
    assert L.consistent(["A", "x", "A", "5"], ["B", "x", "B", "7"], ordinary)
    assert not L.consistent(["A", "x", "A"], ["B", "x", "A"], ordinary)
    assert not L.consistent(["A", "x"], ["A", "y"], ordinary) and not L.consistent(["Ann", "x"], ["committee", "x"], ordinary)
