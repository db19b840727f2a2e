import numpy as np
import pytest

from docloom.llm import bilstm, pii, pii_drawn, sketch

#: Written by hand, in words that the drawn training texts do not use.
KINDS = {
    "You can reach me on (293) 555-0103, thanks.": {"phone"}, "Please contact Marta Keldov at marta+docs@mavonne.example about the ledger.": {"person", "email"}, "Write to ops [at] orvane-mail [dot] invalid.": {"email"},
    "my social security number 666-51-1486 should be in the index, can you check?": {"identity"}, "I moved to 417 Kiln Street, Kirrow, please update the memo.": {"address"}, "I moved to Saddlerstraße 467, 88790 Port Ellery, please update the memo.": {"address"},
    "Her national insurance number is QQ 12 34 56 C.": {"identity"}, "The cheque was cashed by Ingrid Halvorsen on Tuesday.": {"person"}, "Fax the waiver to 0415 555 012 before lunch.": {"phone"}, "passport no. XK4471902 expired": {"identity"}, "| Tenant | Olga Sorenson |": {"person"},
    "Invoice 4471 5329 1180 covers 41 fittings.": set(), "Serial 884-30-0191-22 marks the dashboard.": set(), "Build 10.4.76.80 of the parser was increased.": set(), "The quarry on Canal Street was audited.": set(), "The handle @playbook is unused.": set(),
    "According to Pellucid Foods, the valve was moved.": set(), "Project Gannet depends on Tarn Valley and Cold Harbour.": set(), "": set(),
}


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.trained(), frozenset("you can reach me on thanks please contact at about the ledger write to my social security number should be in index check i moved update memo covers fittings marks dashboard build of parser was increased quarry canal street audited handle playbook is unused according foods valve project depends and her national insurance cheque cashed by fax waiver before lunch passport no expired".split()))


def test_gradients():
    t = bilstm.Tagger(4, embed=5, hidden=6)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, gold = np.array([[6, 7, 8, 9, 10], [11, 12, 13, 0, 0]]), np.array([[0, 1, 2, 3, 0], [1, 1, 0, 0, 0]])
    _, g = t.step(ids, gold)
    r = np.random.default_rng(0)
    for k, v in t.p.items():
        at = tuple(int(r.integers(0, s)) for s in v.shape) if k != "e" else (7, 2)
        if k == "k":
            at = (0, 1)
        old = v[at]
        v[at] = old + 1e-4
        up = t.step(ids, gold)[0]
        v[at] = old - 1e-4
        down = t.step(ids, gold)[0]
        v[at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=0.05, abs=1e-4)


def test_decoders_agree():
    t = bilstm.Tagger(5)
    t.p["t"] = np.random.default_rng(1).standard_normal((5, 5)).astype(np.float32)
    s = np.random.default_rng(2).standard_normal((3, 9, 5)).astype(np.float32)
    for row, got in zip(s, t.decode_many(s, np.array([9, 9, 9]))):
        assert got.tolist() == t.decode(row).tolist()
    assert t.decode_many(s, np.array([9, 4, 1]))[1].tolist() == t.decode(s[1, :4]).tolist()


@pytest.mark.parametrize("text", KINDS)
def test_kinds(finder, text):
    assert {k for *_, k in finder.find([text])[0]} == KINDS[text]


def test_model_decides(finder, monkeypatch):
    """The same look-alike numbers and names, told apart by their surroundings alone; without the model nothing comes."""
    of = lambda text: {k for *_, k in finder.find([text])[0]}
    number = "604-22-9913"
    assert of(f"His SSN is {number}.") == {"identity"} and of(f"Serial {number} marks the pump.") == set()
    assert of("Call 555-0142 tonight.") == {"phone"} and not of("Part 555-0142 was packed.")
    monkeypatch.setattr(finder.model, "scores", lambda ids, kinds: np.eye(pii.LABELS, dtype=np.float32)[np.zeros(ids.shape, int)] * 9)
    assert of(f"His SSN is {number}, ask Marta Keldov at marta@mavonne.example.") == set()


def test_every_character_is_read(finder):
    filler = "the quarry was audited on the street. " * 3000
    text = filler + "You can reach me on (293) 555-0103, thanks. " + filler
    assert [text[a:b] for a, b, _ in finder.find([text, None])[0]] == ["(293) 555-0103"]
    assert finder.find(["x" * 20_000, "", " "]) == [[], [], []]


def test_decoding_only_where_it_matters(finder):
    texts, _, _ = pii_drawn.drawn(60, seed=5)
    got = finder.find(texts)
    whole = lambda scores, edge: [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge), [*np.flatnonzero(edge)[1:], len(edge)])]
    own, finder._open = finder._open, whole
    assert finder.find(texts) == got
    finder._open = own


def test_little_is_decoded(finder):
    """Few characters are left to the decoder beside those in spans: the bound on what a span can gain is tight."""
    texts, _, _ = pii_drawn.drawn(60, seed=5)
    texts = [t + " the quarry was audited on the street. " * 20 for t in texts]
    seen, own = [], finder._open
    finder._open = lambda scores, edge: seen.extend([own(scores, edge), len(edge)]) or seen[-2]
    spans = sum(b - a for found in finder.find(texts) for a, b, _ in found)
    del finder._open
    stretches = [s for r in seen[::2] for s in r]
    assert spans <= sum(b - a for a, b in stretches) < 0.2 * sum(seen[1::2])


def test_bounds(finder):
    """No run of labels gains more by its transitions than the bounds say."""
    enter, leave, keep, base = finder._bounds
    t, r = finder.model.p["t"].astype(float), np.random.default_rng(4)
    for _ in range(3000):
        size, begin = int(r.integers(1, 9)), 1 + 2 * int(r.integers(0, 5))
        run = [begin, *[begin + 1] * (size - 1)] if r.random() < 0.5 else r.integers(1, pii.LABELS, size).tolist()
        path = [0, *run, 0]
        gain = sum(t[i, j] for i, j in zip(path, path[1:])) - t[0, 0] * (len(run) + 1)
        assert gain <= enter[run[0] - 1] + leave[run[-1] - 1] + keep * len(run) + base + 1e-3


def test_scores_of_rows_of_any_length():
    """Scores in rows of unequal lengths are those of each row by itself, and those that the training sees."""
    m, r = pii.trained(), np.random.default_rng(8)
    sizes = [1, 2, 3, 40, 41, 77, 90, 90] + [int(n) for n in r.integers(1, 90, 40)]
    ids, kinds = np.zeros((len(sizes), 90), np.uint8), np.zeros((len(sizes), 90), np.uint8)
    for row, kind, n in zip(ids, kinds, sizes):
        row[:n], kind[:n] = r.integers(1, bilstm.SYMBOLS, n), r.integers(0, len(pii.WORD_KINDS), n)
    got = m.scores(ids, kinds)
    for row, kind, n, s in zip(ids, kinds, sizes, got):
        x = (m.p["e"][row[:n]] + m.p["k"][kind[:n]])[:, None]
        on = np.ones((n, 1, 1), np.float32)
        hidden = np.concatenate([m._run(x, on, "f", False)[0], m._run(x[::-1], on, "r", False)[0][::-1]], 2)
        assert s[:n] == pytest.approx((hidden @ m.p["w"] + m.p["b"])[:, 0], abs=1e-3)


def test_word_kinds_of_joined_texts():
    texts = ["Anna", "lives in Kiln Street", "", "7", "Straße x", "\U0001d400b Anna"]
    memo = pii.Memo({"lives"})
    whole = pii.word_kinds("\n".join(texts), {"lives"}, memo)
    assert whole.tolist() == [k for t in texts for k in [*pii.word_kinds(t, {"lives"}), 0]][:-1]
    assert pii.word_kinds("Anna", ()).tolist() == [pii.WORD_KINDS.index("given")] * 4


def test_words_are_those_of_the_pattern():
    for text in ["", "Anna's 2nd re-read: naïve_x\n\u00a0Größe", "\U00020000\U00020001b \U0001f600 c", "a\ud800b \u2028 c\x1cd", "ⅷ ª º ²x ٣y"]:
        assert sketch.words(*sketch.letters(text)) == sketch.WORD.findall(text)
        assert (pii.word_kinds(text, {w.lower() for w in sketch.WORD.findall(text)}) > 0).tolist() == [sketch.WORD.match(c) is not None for c in text]


def test_windows_are_shared_out(finder):
    """Where windows overlap, their shares sum to one, whatever the size of the last; constant scores stay what they are."""
    for size in (65, 66, 100, 127, 128, 480):
        assert sum(pii._shares(min(size, 128))) == pytest.approx(np.ones(pii.OVERLAP))
    ids = np.full(3000, 9, np.uint8)
    finder = pii.Finder(bilstm.Tagger(pii.LABELS, len(pii.WORD_KINDS), pii.EMBED, pii.HIDDEN))
    finder.model.scores = lambda x, z: np.tile(np.arange(pii.LABELS, dtype=np.float32), (*x.shape, 1))
    sizes = [480, 481, 545, 500, 994]
    got = finder._scores(ids, ids * 0, np.cumsum([0, *sizes[:-1]]), sizes)
    assert got == pytest.approx(np.tile(np.arange(pii.LABELS)[:, None], 3000), abs=1e-5)


def test_held_out():
    texts, gold, _ = pii_drawn.drawn(600, seed=77)
    usual = pii_drawn.Drawer(77).usual
    hit = total = wrong = 0
    for found, y in zip(pii.Finder(pii.trained(), usual).find(texts), gold):
        want = {pii.KINDS[(v - 1) // 2] for v in y if v % 2}
        have = {k for *_, k in found}
        hit, total, wrong = hit + len(want & have), total + len(want), wrong + len(have - want)
    assert hit >= 0.95 * total and wrong <= 0.05 * total


def test_training_learns():
    """A few steps on drawn texts: the loss falls, and the weights are what is read back."""
    texts, gold, kinds = pii_drawn.drawn(800, seed=3)
    losses = bilstm.Tagger(pii.LABELS, len(pii.WORD_KINDS), pii.EMBED, pii.HIDDEN).fit(texts, gold, 4, batch=32, kinds=kinds)
    assert losses[-1] < 0.6 * losses[0]


def test_redact():
    assert pii.redact("a b c", [(2, 3, "person")]) == "a [PERSON] c"


def test_table(spark):
    rows = [("a", "You can reach me on (293) 555-0103, thanks.", 1), ("a", "You can reach me on (293) 555-0103, thanks.", 2), ("b", None, 3), ("c", "", 4), (None, "x", 5)]
    df = spark.createDataFrame(rows, "document_id string, text string, kinds int")
    out = {r.record_key: r for r in pii.personal(df, "document_id", "text").collect()}
    assert out["a"].text == "You can reach me on [PHONE], thanks." and out["a"].kinds == ["phone"]
    assert out["b"].text is None and out["c"].text == "" and set(out) == {"a", "b", "c"}
    empty = df.limit(0)
    assert pii.found(empty, empty.selectExpr("1L AS id", "text AS content")).count() == 0
