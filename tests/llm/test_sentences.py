import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import sentences as S


def cut(text):
    out, at = [], 0
    for e in S.units(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Reed met Mrs. Stone at 4.30 p.m. on May 3. They left.", ["Dr. Reed met Mrs. Stone at 4.30 p.m. on May 3.", "They left."]), ("Orvane Inc. moved it. See Fig. 4 and No. 5, cf. Art. 6.", ["Orvane Inc. moved it.", "See Fig. 4 and No. 5, cf. Art. 6."]),
        ('"Hold it," said Mrs. Reed, "until Sec. 3 is done." He left.', ['"Hold it," said Mrs. Reed, "until Sec. 3 is done."', "He left."]), ('She asked, "Is it done?" and left. Why wait?! (It was done.) Yes.', ['She asked, "Is it done?" and left.', "Why wait?!", "(It was done.)", "Yes."]),
        ("We waited ... and left. It cost 3.5 percent.", ["We waited ... and left.", "It cost 3.5 percent."]), ("Das ist gut. „Ist das neu?“, fragte er. Am 3. März war es z. B. fertig.", ["Das ist gut.", "„Ist das neu?“, fragte er.", "Am 3. März war es z. B. fertig."]),
        ("Er sagte: „Das ist neu.“ Wer wartet?", ["Er sagte: „Das ist neu.“", "Wer wartet?"]), ("Le taux baisse. « C'est fait », dit M. Roux. Voir p. 3.", ["Le taux baisse.", "« C'est fait », dit M. Roux.", "Voir p. 3."]), ("Отчёт за 2020 г. готов, т. е. сдан. См. стр. 5.", ["Отчёт за 2020 г. готов, т. е. сдан.", "См. стр. 5."]),
        ("主任说：“预算已经归档。”清单完成了吗？“索引呢？”她问道，“更新了没有？”好。", ["主任说：“预算已经归档。”", "清单完成了吗？", "“索引呢？”她问道，“更新了没有？”", "好。"]), ("課長は「終わった。」と述べた。遅すぎる！", ["課長は「終わった。」と述べた。", "遅すぎる！"]),
        ("रिपोर्ट लिखी गई। कितनी देर!", ["रिपोर्ट लिखी गई।", "कितनी देर!"]), ("รายงานเสร็จแล้ว มีค่า 3 หน้า หัวหน้ากล่าวว่า “ดี” วันนี้", ["รายงานเสร็จแล้ว", "มีค่า 3 หน้า", "หัวหน้ากล่าวว่า “ดี” วันนี้"]),
        ("# Head\nFirst one\ngoes on. Second.\n\n- item one\n- item two\n  goes on\n\nRate: 3.5\nBranch: Kirrow\n\n1. Do it.\n2. Stop.", ["# Head", "First one\ngoes on.", "Second.", "- item one", "- item two\n  goes on", "Rate: 3.5", "Branch: Kirrow", "1. Do it.", "2. Stop."]),
        ("It ended.The next began. Open report.final.pdf now.", ["It ended.", "The next began.", "Open report.final.pdf now."]), ("It went carefully.Dr. Reed left. It reads \"none.\" edeposit users left.", ["It went carefully.", "Dr. Reed left.", 'It reads "none."', "edeposit users left."]), ("", []), (" \n\t", []), ("no end at all", ["no end at all"]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.?! \n\"“”„«»()-#1:。！“と", max_size=120))
def test_units_cover_the_text(text):
    ends = S.units(text)
    assert ends == sorted(set(ends)) and all(text[e - 1] not in S.BLANKS for e in ends)
    at = ends[-1] if ends else 0
    assert not text[at:].strip(S.BLANKS)


def test_thai_behind_a_long_opening():
    assert len(S.units("1234567 " * 60 + "รายงานเสร็จแล้ว ทีมงานกลับบ้าน")) == 2


def test_look_back_has_no_cap():
    cited = "See " + " ".join(f"Art. {i}" for i in range(1, 16)) + " of the act."
    assert cut(cited + " Done.") == [cited, "Done."]
    quoted = "She said “" + " ".join(f"Part {i} was moved." for i in range(1, 16)) + "” and left."
    assert cut("It began. " + quoted + " Done.") == ["It began.", quoted, "Done."]
    assert len(S.units("See " + "Art. 5 " * 20_000 + "here.")) == 1


def test_long_text_is_linear():
    assert len(S.units("One more thing. " * 20_000)) == 20_000
    assert S.units("x" * 300_000) == [300_000]


def test_table(spark):
    rows = [(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 5), (3, " ", 5), (None, "One.", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_pos int")
    assert sorted((r.doc_id, r.end_pos) for r in S.split_sentences(df).collect()) == [(1, 4), (1, 9)]
    assert sorted(r.text for r in S.split_sentences(df, with_text=True).collect()) == ["One.", "Two."]
    assert S.split_sentences(df.limit(0)).count() == 0
