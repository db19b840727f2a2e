from docloom.llm import scans as S

BODY = ["The survey crew moved the quiet ledger to the harbour office in March.", "Every valve of the warehouse was tested by the night shift.", "The workflow lists parcels, ledgers and one harbour."]


def page(i, text=None, head="Mill Works — Quiet Ledger", number=None):
    body = text or "\n".join(BODY)
    return "\n".join(x for x in (head, body, number) if x)


def frame(spark, rows):
    return spark.createDataFrame([(f"f_pdf_p{n}", src, kind, n, t, "clash") for n, src, kind, t in rows], "document_id string, source_name string, file_type string, page_number int, text string, noise string")


def found(df):
    out = {}
    for r in S.found(df).collect():
        out.setdefault(r.document_id, set()).add(r.noise)
    return out


def test_kinds(spark):
    rows = [(i, "f.pdf", "pdf", page(i, number=f"- {i} -")) for i in range(1, 9)]
    rows += [(9, "f.pdf", "pdf", "\n".join(BODY).replace("warehouse", "ware-\nhouse").replace("workflow", "w0rkf1ow")), (10, "f.pdf", "pdf", "\n".join(BODY) + "\nTenure in months\n10"), (11, "g.pdf", "pdf", "Lone Title Here\n" + BODY[0]), (12, "g.pdf", "pdf", "Mill Works — Quiet Ledger  Page 12\n" + BODY[0])]
    rows += [(13, "g.pdf", "pdf", None), (14, "g.pdf", "pdf", " \n"), (1, "f.pdf", "pdf", page(1, number="- 1 -")), (15, "t.txt", "txt", page(15).replace("warehouse", "w@rehouse"))]
    got = found(frame(spark, rows))
    assert all(got[f"f_pdf_p{i}"] == {"header", "page_number"} for i in range(1, 9))
    assert got["f_pdf_p9"] == {"hyphenation", "misread"}
    assert "f_pdf_p10" not in got and "f_pdf_p11" not in got and "f_pdf_p15" not in got
    assert got["f_pdf_p12"] == {"page_number"}


def test_repaired_text(spark):
    rows = [(i, "f.pdf", "pdf", page(i, number=f"Page {i} of 6")) for i in range(1, 6)] + [(6, "f.pdf", "pdf", "Mill Works — Quiet Ledger\nThe survey crew tested the ware-\nhouse. The w0rkflow\nlists parcels.\n\nSecond part.\n6 / 6")]
    text = {r.document_id: r.text for r in S.repair(frame(spark, rows)).collect()}["f_pdf_p6"]
    assert text == "The survey crew tested the warehouse. The workflow lists parcels.\n\nSecond part."


def test_compounds_keep_their_hyphen():
    w = S.Words(S.Pages.of({"long-term": 9, "warehouse": 9, "house": 9, "ware": 1, "sign": 9, "off": 9}))
    assert not w.broken("", "long", "term", "") and w.broken("", "ware", "house", ".")
    assert not w.broken("", "sign", "off", "") and not w.broken("", "Morholt", "Ulrosk", "") and not w.broken("TCK8", "a", "b", "")
    assert S.paragraphs("a long-\nterm plan", "23", w)[0] == "a long-term plan"


def test_misread_words():
    w = S.Words(S.Pages.of({"northern": 90, "modern": 80, "guarantee": 50, "drivers": 40, "harbour": 40, "matched": 30}))
    assert {t: w.read_as(t) for t in ("northem", "m0dern", "gu@rantee", "drivcrs", "liarbour", "matclied", "harbour", "kiln")} == {"northem": "northern", "m0dern": "modern", "gu@rantee": "guarantee", "drivcrs": "drivers", "liarbour": "harbour", "matclied": "matched", "harbour": None, "kiln": None}
    assert w.misread("a@b.example") is None and w.misread("TCK-0440") is None


def states(m, text, page, recurs=()):
    symbols, cues, keys = S.read_page(text, page)
    shown = "".join(c.upper() if k and l in recurs else c for c, k, l in zip(symbols, keys, text.split("\n")))
    return [S.STATES[x] for x in m.label([(shown, cues)])[0]]


def test_model_marks_furniture_only():
    m = S.LineModel()
    text = "Mill Works — Quiet Ledger\n" + "\n".join(BODY) + "\n\n- 7 -"
    assert states(m, text, 7, {"Mill Works — Quiet Ledger"}) == ["header", "first", "first", "first", "break", "number"] or states(m, text, 7, {"Mill Works — Quiet Ledger"})[::5] == ["header", "number"]
    assert not {"header", "number"} & set(states(m, "\n".join(BODY * 3), 7))


def test_model_decides_where_rules_fail():
    """Lines that recur on three pages, or carry the page's number, and are text all the same; and furniture of any depth."""
    m = S.LineModel()
    form = "Tenure\n9\nBranch\nPort Ellery\nApplicant\nMarta Holt\nRate: 4\nTotal\n7"  # "Tenure" is not the page's title
    assert not {"header", "number"} & set(states(m, form, 7, {"Tenure", "Branch", "Applicant", "Total"}))
    deep = "Mill Works\nQuiet Ledger\nHarbour Office\nSurvey Crew\nPage 7\n\n" + "\n".join(BODY)
    got = states(m, deep, 7, {"Mill Works", "Quiet Ledger", "Harbour Office", "Survey Crew"})
    assert got[:5] == ["header"] * 4 + ["number"]


def test_counts_keep_their_scale():
    p = S.Pages.of({"a": 4, "b": 1000, "c": 10**9})
    assert all(abs(p["abc"[i]] / n - 1) < 0.1 for i, n in enumerate((4, 1000, 10**9))) and "d" not in p and p.get("d", 0) == 0


def test_empty(spark):
    df = frame(spark, [(1, "f.pdf", "pdf", "x")]).limit(0)
    assert S.found(df).count() == 0 and S.repair(df).count() == 0
