import pytest

from docloom.llm import pairs as P

SOUND = ["The harbour was rebuilt in March by the survey crew.", "A ledger lists 3 crates and one valve.", "The night shift moved the depot. The figures were: 3 and 4. It was kept (see the memo).", "The list:\n- quiet ledger\n- moved depot\n- sound harbour", "The list:\n- moved harbour\n- quiet depot", "They are:\n- sound ledger\n- quiet valve", "Port Ellery", "29.2 percent", "41 crates"] * 60
MODEL = P.Endings(SOUND)


def kind(message, text):
    if P.is_empty(text):
        return "empty"
    if P.is_copy(message, text):
        return "copy"
    if P.is_refusal(text):
        return "refusal"
    if P.is_other_language(message, text):
        return "other_language"
    return "truncated" if MODEL.is_truncated(text) else None


@pytest.mark.parametrize(
    ("message", "text", "want"),
    [
        ("q", None, "empty"), ("q", " ​[SOURCE 1] ...", "empty"), ("Why was the gasket kept?", "why was the gasket kept", "copy"), ("Why was the gasket kept?", "You asked: Why was the gasket kept?", "copy"), ("Why was the gasket kept?", "Why was the gasket kept? Why was the gasket kept?", "copy"),
        ("Why was the gasket kept?", "The gasket was kept because the valve leaked in March and nobody had another one.", None), ("Why?", "I'm sorry, but I can't help with that request.", "refusal"), ("Why?", "Thanks for asking, but I must decline. Please contact the office.", "refusal"), ("Wann?", "Das beantworte ich nicht.", "refusal"),
        ("Why?", "Orvane Foods was sorry and could not help the valve.", None), ("Why?", 'The clerk wrote: "I cannot answer this." The claim was settled in June.', None), ("When did the shift start?", "Der Vertrag wurde im Keller geprüft und die Anlage ist ergänzt.", "other_language"),
        ("Translate the note into German.", "Der Vertrag wurde im Keller geprüft und die Anlage ist ergänzt.", None), ("Was steht im Vertrag?", "Der Vertrag wurde im Keller geprüft.", None), ("When was the valve moved?", "阀门已经移动。", "other_language"),
        ("Where?", "Port Ellery", None), ("How many?", "29.2 percent [SOURCE 2]", None), ("How?", "The harbour was rebuilt. Then the", "truncated"), ("How?", "The harbour was rebu", "truncated"), ("How?", "The harbour was rebuilt (see the", "truncated"), ("How?", "The harbour was rebuilt. [SOURCE", "truncated"),
        ("List them.", "The list:\n- quiet harbour\n- moved depot\n-", "truncated"), ("List them.", "The list:\n- quiet ledger\n- moved depot", None), ("How?", "The figures were:", "truncated"), (None, "The harbour was rebuilt in March.", None), ("x" * 5000, "The harbour was rebuilt in March." * 300, None),
    ],
)
def test_kinds(message, text, want):
    assert kind(message, text) == want


def test_script_is_counted_over_the_whole_text():
    assert P.language("Отчёт готов. " * 160 + "The report is ready. " * 900)[0] == "en"
    assert P.language("The report is ready. " * 100 + "Отчёт готов. " * 900)[0] == "ru"


def test_long_refusal():
    assert P.is_refusal("I cannot answer this question. " * 8 + "I hope you understand.")
    assert not P.is_refusal("") and not P.is_refusal("I cannot answer this question. " * 8 + "The valve was moved in May.")


def test_compression_decides_on_copies(monkeypatch):
    asked = "explain section nine of the seasonal ledger please"
    assert P.packed(P.coded(asked), P.coded(asked)) < 0.5 * P.packed(P.coded(asked))
    assert P.is_copy(asked, asked.upper() + "! " + asked * 8) and P.is_copy("Why?", "why why why")  # however often
    other = "The seasonal ledger was moved in May by the survey crew."
    assert not P.is_copy(asked, other)
    monkeypatch.setattr(P, "packed", lambda text, dictionary=None: 0)
    assert P.is_copy(asked, other)


def test_model_decides_on_ends():
    """On responses it has not seen, cut at any place, against the same responses whole."""
    import random

    r = random.Random(2)
    nouns, verbs = "harbour ledger valve depot kiln crate orchard memo".split(), "moved rebuilt sold painted stored".split()
    say = lambda: f"The {r.choice(nouns)} was {r.choice(verbs)} in {r.choice(['March', 'June'])} by the {r.choice(nouns)} crew."
    drawn = [" ".join(say() for _ in range(r.randint(1, 3))) if r.random() < 0.8 else r.choice(["Port Ellery", "29 percent", "Kirrow", "41,780"]) for _ in range(900)]
    model = P.Endings(drawn[:600])
    long = [t for t in drawn[600:] if len(t) > 30]
    cut = [t[: r.randint(10, len(t) - 2)] for t in long]
    cut = [t for t in cut if t.rstrip()[-1] not in "."]
    assert sum(map(model.is_truncated, drawn[600:])) <= 2 and sum(map(model.is_truncated, cut)) >= 0.98 * len(cut)
    model.weights = model.weights * 0
    assert not any(map(model.is_truncated, cut))


def test_table(spark):
    rows = [(1, "q", None, "a"), (1, "q", None, "a"), (2, None, "The harbour was rebuilt in March.", "b"), (None, "q", None, "a")]
    df = spark.createDataFrame(rows, "turn_id long, message string, text string, defect string")
    assert [(r.turn_id, r.defect) for r in P.find_defects(df).collect()] == [(1, "empty")]
    assert P.find_defects(df.limit(0)).count() == 0
    by = {(r.mode, r.defect): r.turns for r in P.by_mode(df.withColumnRenamed("defect", "mode")).collect()}
    assert by == {("a", "empty"): 1, ("b", "none"): 1}


def test_model_is_fitted_on_all_responses(spark):
    """The same words, ends and weights however the responses lie, each of them counted once."""
    texts = [*dict.fromkeys(SOUND), *(f"The depot {k} was moved by crew {k % 7}." for k in range(150))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "turn_id long, text string").repartition(5)
    model, known = P.Endings(texts), P.counted(df).collect()
    assert {r.word: (r.n, r.closes) for r in known if r.end is None} == {w: (n, model.counts.closes[w]) for w, n in model.counts.seen.items()}
    assert {(bytes(r.end), r.word, r.y): r.n for r in known if r.end is not None} == model.counts.ends
    rows = [(bytes(e), y, n, model.counts.seen[w], model.counts.closes[w]) for (e, w, y), n in model.counts.ends.items()]
    examples = spark.createDataFrame(rows, "end binary, y int, n long, seen long, closes long").repartition(3)
    assert P.weights(examples) == pytest.approx(model.weights, abs=1e-6)
    cut = [t[: 9 + i] for i, t in enumerate(texts[:20]) if len(t) > 40]
    more = spark.createDataFrame([(i, "q", t) for i, t in enumerate([*texts, *cut])], "turn_id long, message string, text string")
    own = P.Endings([*texts, *cut])
    assert {r.turn_id for r in P.find_defects(more).where("defect = 'truncated'").collect()} == {i for i, t in enumerate([*texts, *cut]) if own.is_truncated(t)}
