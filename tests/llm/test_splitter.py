import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitter as S


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .\n#-\r\té", max_size=500), st.integers(5, 80), st.integers(0, 40))
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    spans = S.pieces(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in spans)
    assert all(text[s] not in S.BLANKS and text[e - 1] not in S.BLANKS for s, e in spans)
    assert all(a < c and b < d and c >= b - overlap for (a, b), (c, d) in zip(spans, spans[1:]))
    seen = {i for s, e in spans for i in range(s, e)}
    assert all(i in seen for i, ch in enumerate(text) if ch not in S.BLANKS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=200), st.integers(3, 40))
def test_cut_level(text, limit):
    blank = " \t\n\r"
    t = text.strip(blank)
    if len(t) <= limit:
        assert S.Tree(text).level(limit) is None
        return
    lines, paragraphs = t.split("\n"), [[]]
    for l in lines:
        paragraphs[-1].append(l) if l.strip(blank) else paragraphs.append([])
    fits = lambda parts: all(len(p.strip(blank)) <= limit for p in parts)
    want = "paragraph" if fits("\n".join(p) for p in paragraphs) else "line" if fits(lines) else "word" if fits(t.split()) else "unbroken"
    assert S.Tree(text).level(limit) == want


def test_natural_boundaries():
    text = "# One\n\n" + "First sentence here. " * 30 + "\n\n# Two\n\n" + "Second part there. " * 30
    spans = S.pieces(text, 900, 120)
    assert any(text[e:].lstrip().startswith("# Two") or text[s:].startswith("# Two") for s, e in spans)
    assert [e - s for s, e in S.pieces("x" * 2000, 900, 120)] == [780, 900, 560]
    with pytest.raises(ValueError):
        S.pieces("x", 10, 10)


def test_only_siblings_are_merged():
    text = "# A\n\n" + "First words here. " * 60 + "\n\n# B\n\n" + "Second words there. " * 8 + "\n\n## B1\n\nA short end.\n\n# C\n\n" + "Third words now. " * 60
    added = [text[s:e] for s, e in S.pieces(text, 400, 0)]
    for p in added:  # no piece holds parts of two sections of one level, and no heading stands at a piece's end
        assert sum(p.count(f"# {h}\n") for h in "ABC") <= 1
        assert not p.splitlines()[-1].startswith("#")
    assert any(p.startswith("# B\n") and p.endswith("A short end.") for p in added)  # a section that fits stays whole


def test_lists_are_cut_between_items():
    text = "\n".join(f"- item {i} " + "words " * 12 for i in range(40))
    assert all(text[s:e].startswith("- item") for s, e in S.pieces(text, 300, 0))


def test_level_is_read_off_the_tree():
    assert S.Tree("a" * 30 + "\n# Head\n" + "b" * 30).level(40) == "line"  # a heading inside a part does not part it
    assert S.Tree("字" * 20 + "。" + "字" * 20).level(30) == "unbroken"  # no blank, though a sentence ends inside


def test_table(spark):
    rows = [("a", "w " * 600, 1), ("a", "w " * 600, 2), ("b", None, 3), ("c", " \n", 4), (None, "short", 5), ("d", "x" * 901, 6)]
    df = spark.createDataFrame(rows, "document_id string, text string, chunk_index int")
    out = S.split(df).collect()
    assert {r.document_id for r in out} == {"a", None, "d"}
    assert [(r.chunk_index, r.total_chunks) for r in out if r.document_id is None] == [(0, 1)]
    assert {(r.document_id, r.cut_level) for r in S.found(df).collect()} == {("a", "word"), ("d", "unbroken")}
    assert S.split(df.limit(0)).count() == 0
