"""Sentence units of texts in any language and script.

A text is cut into blocks at blank lines, and lines that are units by themselves (headings, list items, label lines) are
taken out. In running prose every place that could end a sentence is a candidate; a semi-Markov dynamic program then
picks the best whole spans. A span's score adds what its end says (mark, closing word, what follows), how it opens, its
length, and whether its quotations and brackets are balanced, so that a mark inside a quotation does not end a span
whose quotation is still open.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations in lower case, without the last full stop.
TITLES = frozenset("mr mrs ms messrs dr drs prof rev hon gen col capt lt sgt st sen rep gov pres hr fr frl dra sr sra srta d dña ud uds m mm mme mlle mgr ing dipl mag г-н г-жа проф акад доц им тов डॉ प्रो श्री पं".split())
BEFORE_NUMBER = frozenset("no nos nr nrn fig figs sec secs sect p pp pg pgs par para art arts abs anl abb tab tabs ch chap vol vols cl ver v eq eqs ex app bd kap s z ziff rn núm num pág págs pag cap t lám n стр с рис табл гл п пп ст т № पृ सं क्र".split())
INSIDE = frozenset("vs cf viz al approx ca ggf bzw evtl inkl exkl usf sog vgl dgl bspw etwa resp i.e e.g z.b d.h u.a o.ä i.d.r p.ex c.-à-d c-à-d ej p.ej см ср напр тыс млн млрд руб т.е т.к incl excl esp dept est env éd op cit ibid".split())
MAY_END = frozenset("etc inc ltd co corp jr sr bros plc llc a.m p.m am pm u.s u.k e.u jan feb mar apr jun jul aug sep sept oct nov dec usw u.s.w г гг др пр т.д т.п и.т.д ee.uu cía av ave blvd rd no jän mrz okt dez janv févr juil déc ene abr ago".split())
GERMAN_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert kapitel stock mal".split())
OPENERS = frozenset("the a an this that these those it he she they we you i there then both most each every few two only under after before because unless while instead neither once should if later according almost what when where why how no as at for by from with to almost their its our his her in on".split())
GO_ON = frozenset("and or but on in at of to for by from with as the a an is are was were has had will that which who und oder aber ist war wird in im am mit für von zu et ou mais est sur en de du pour par avec y o pero es en de con por para и или но в на с для за от до из не проверен подписан".split())

REPORTING = frozenset("said asked wrote replied added says asks writes noted explained answered called sagte fragte schrieb rief dit demanda écrit dijo preguntó escribió сказал сказала спросил спросила написал".split())

CLOSERS = "\"'”’»›“‘)]}）］｝】〉》」』"
CANDIDATE = re.compile(r"(?:\.{2,}|…+|[.!?]+|[。！？｡．।॥؟۔]+)(?:[!?…。！？]*)")
THAI_GAP = re.compile(r"(?<=[ก-๙])[ \t\n\r]+(?=[ก-๙])")
HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]+\S")
BULLET = re.compile(r"^[ \t]*[-*•‣◦▪·–—][ \t]+\S")
NUMBERED = re.compile(r"^[ \t]*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[ivxIVX]{1,4}[.)]|\d+(?:\.\d+)+\.?)[ \t]+\S")
LABEL = re.compile(r"^[ \t]*[^\W\d_][^.!?:：。！？\"“”„«»「」]{0,40}[:：][ \t]+[^\"“”„«»「」。！？]{1,80}$")
RULE = re.compile(r"^[ \t]*(?:[-=_*~][ \t]*){3,}$")
REPORT_ZH = re.compile(r"^[，,]?\s*(?:[她他我你它]们?|[一-鿿]{1,4})(?:[一-鿿]{0,2})(?:问|说|道|答|喊|叫|笑|写|表示|回答)")
TAIL_WORD = re.compile(r"([^\s\"“”„«»‘’()\[\]（）「」『』,;:!?]+)$")
BLANKS = " \t\n\r"


_AFTER_CAPITAL = frozenset("abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùœæñáíóúøåабвгдежзийклмнопрстуфхцчшщъыьэюяё ")


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def closing(text: str, at: int, end: int) -> int:
    """Where the closing marks behind position ``at`` end; an opening-and-closing mark counts only directly behind."""
    while at < end and text[at] in CLOSERS:
        if text[at] == "“" and at + 1 < end and (text[at + 1].isalnum() or _cjk(text[at + 1])) and text[at - 1] not in ".!?…":
            break
        if text[at] == "“" and _cjk(text[at - 1]) or text[at] == "“" and text[at - 1] in "。！？”":
            break
        if text[at] in "\"'" and at + 1 < end and text[at + 1].isalnum():
            break
        at += 1
    return at


def end_score(text: str, start: int, mark: int, stop: int, end: int) -> float | None:
    """How well a unit ends at ``stop`` (behind closing marks); ``mark`` is where its mark begins. None: never."""
    sign = text[mark : stop].rstrip(CLOSERS)
    closers = text[mark + len(sign) : stop]
    at = stop
    while at < end and text[at] in BLANKS or at < end and text[at] in " ​﻿　":
        at += 1
    if at >= end:
        return 3.0
    gap, nxt = at > stop, text[at]
    wide = sign[0] in "。！？｡．"
    if nxt in ",;:，；、：)]}）】" or nxt in "—–-" and gap and at + 1 < end and text[at + 1] == " ":
        return None
    follow = re.match(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", text[at : at + 40])
    word = follow[0] if follow else ""
    opens = nxt in "\"'“„«‘(（「『《[¿¡#"
    if wide or sign[0] in "…" and sign.startswith("……"):
        score = 3.0
        if sign[0] == "…":
            return -2.0 if not opens and not closers and "\n" not in text[stop:at] else 0.5
        if closers:
            if nxt == "と" or nxt in "のがをはに" and _cjk(nxt):
                return None
            if REPORT_ZH.match(text[at : at + 12]):
                # a quotation that opens the sentence is followed by its reporting clause
                opened = max(text.rfind("“", start, mark), text.rfind("「", start, mark), text.rfind("\"", start, mark))
                before = text[opened - 1] if opened > start else ""
                if opened >= 0 and (before in "" or before in "。！？…”」\n "):
                    return None
        return score
    if sign[0] in "।॥؟۔":
        return 3.0 if not (closers and nxt.isalpha() and gap and word in ("कहा", "पूछा")) else None
    if not gap and not (opens and closers) and not _cjk(nxt):
        # a lost blank: only between an ordinary word and a capitalised one or an opening mark
        first = at + opens
        glued = text[mark - 1].isalnum() and not text[mark - 1].isupper() and text[first : first + 1].isupper() and text[first + 1 : first + 2] in _AFTER_CAPITAL
        run = re.search(r"\S*$", text[max(start, mark - 60) : mark])[0] + re.match(r"\S*", text[mark : mark + 60])[0]
        if not glued or re.search(r"[@/\\_]|www\.|://", run) or run.count(".") > 2 or len(sign) > 1 and sign[0] == ".":
            return None
        return 1.5
    lower = nxt.islower()
    if sign[0] in "!?" or any(c in "!?" for c in sign):
        if closers and lower:
            return -4.0
        return 2.0 if lower else 3.0
    if sign.startswith("..") or sign[0] == "…":
        return -4.0 if lower else 1.0
    # a full stop
    tail = TAIL_WORD.search(text, max(start, mark - 40), mark)
    last = tail[1] if tail else ""
    low = last.lower().strip("'’")
    glued = re.fullmatch(r".*[^\W\d_]{3,}\.([^\W\d_]+)", last)
    if glued and glued[1][0].isupper():  # the word before lost its blank
        last = glued[1]
        low = last.lower()
    digit = nxt.isdigit()
    if closers and lower:
        # unlike a question or exclamation, a quoted statement that goes on takes a comma
        return -4.0 if word in GO_ON or word in REPORTING or len(sign) > 1 else 0.5
    if closers:
        return 3.0 if low not in TITLES else 1.0
    if low in INSIDE:
        return -5.0
    two = re.search(r"(\S+)\s(\S+)$", text[max(start, mark - 16) : mark])
    if len(low) == 1 and last.isalpha():
        pair = f"{two[1].lower().rstrip('.')}.{low}" if two else low
        if pair in ("p.m", "a.m", "т.д", "т.п", "т.е", "z.b", "d.h", "u.a", "p.ej"):
            if pair in ("z.b", "d.h", "u.a", "т.е", "p.ej"):
                return -5.0
            return -5.0 if lower and word in GO_ON else 2.0
        if lower:
            return -5.0 if low not in ("г",) or lower else 2.0
        if low == "г":
            return 1.5
        if digit:
            return -4.0 if low in BEFORE_NUMBER or low in TITLES else 1.5
        if last.isupper():
            return 1.0 if word.lower() in OPENERS and len(word) > 1 else -4.0
        return -5.0 if low in TITLES or low in BEFORE_NUMBER else 2.0
    if low in TITLES:
        return -5.0
    if low in BEFORE_NUMBER:
        if digit or lower:
            return -5.0
        return 2.0 if low == "no" else -1.0
    if low in MAY_END:
        if digit:
            return -3.0
        if lower:
            return -5.0 if low not in ("p.m", "a.m", "pm", "am") or word in GO_ON else 1.5
        return 1.5 if word.lower() in OPENERS or opens else 1.0
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
        if low in ("p.m", "a.m"):
            return -5.0 if lower and word in GO_ON else 2.0
        return -5.0 if lower else 0.5
    if last.isdigit() and len(last) <= 2 and word.lower() in GERMAN_MONTHS:
        return -5.0
    if lower:
        return 1.5 if len(low) > 1 else -3.0
    return 3.0


PAIRS = (("(", ")"), ("[", "]"), ("（", "）"), ("「", "」"), ("『", "』"), ("«", "»"), ("《", "》"))


def balance(text: str, bounds: list[int]) -> Callable[[int, int], int]:
    """Of the span between two of ``bounds``, by their places: quotations and brackets left open or closed without being
    opened. Marks are counted once up to every bound, so that a long span costs no more than a short one."""
    have = {}
    for c in {*"".join(a + b for a, b in PAIRS), *"„“”\""}:
        if text.find(c, bounds[0], bounds[-1]) >= 0:
            have[c] = [0]
            for a, b in zip(bounds, bounds[1:]):
                have[c].append(have[c][-1] + text.count(c, a, b))
    if not have:
        return lambda i, j: 0
    count = lambda c, i, j: have[c][j] - have[c][i] if c in have else 0
    pairs = [(a, b) for a, b in PAIRS if a in have or b in have]

    def off(i: int, j: int) -> int:
        n = sum(abs(count(a, i, j) - count(b, i, j)) for a, b in pairs)
        low, left, right = count("„", i, j), count("“", i, j), count("”", i, j)
        n += abs(low - left - right) if low else abs(left - right)
        return n + count('"', i, j) % 2

    return off


QUOTES = re.compile("[„“”«»「」『』《》()（）\\[\\]\"]")
CLOSED_BY = {**dict(PAIRS), "“": "”", "„": "“”"}


def enclosed(text: str, start: int, end: int, ends: list[int], scores: list[float]) -> set[int]:
    """Which of ``ends`` stand inside a quotation or bracket whose sentence goes on behind it."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    for m in QUOTES.finditer(text, start, end):
        c, at = m[0], m.start()
        if stack and (c in CLOSED_BY.get(stack[-1][0], "") or c == stack[-1][0] == '"'):
            opened = stack.pop()[1]
            lo, hi = bisect_right(ends, opened), bisect_right(ends, at)
            behind = at + 1
            while behind < end and text[behind] in BLANKS:
                behind += 1
            # it goes on with a small letter or a comma; an end at or right behind the closing mark says it does not
            goes_on = behind < end and (text[behind].islower() or text[behind] in ",;，；、")
            if hi > lo and goes_on and not (hi < len(ends) and ends[hi] <= behind and scores[hi] >= 0):
                out.update(range(lo, hi))
        elif c in CLOSED_BY or c == '"':
            stack.append((c, at))
    return out


def spans(text: str, start: int, end: int) -> list[int]:
    """Ends (exclusive) of the units of the running prose ``text[start:end]``."""
    ends, scores = [], []
    for m in CANDIDATE.finditer(text, start, end):
        stop = closing(text, m.end(), end)
        if (s := end_score(text, start, m.start(), stop, end)) is not None:
            ends.append(stop)
            scores.append(s)
    marks = len(ends)
    for m in THAI_GAP.finditer(text, start, end):
        # short runs between blanks are phrases, and a blank inside a quotation is no end
        if "ๆ" not in text[m.end() : m.end() + 1]:
            ends.append(m.start())
            scores.append(2.0)
    if len(ends) > marks:
        order = sorted(range(len(ends)), key=ends.__getitem__)
        ends, scores = [ends[i] for i in order], [scores[i] for i in order]
    if inner := enclosed(text, start, end, ends, scores):
        ends, scores = ([x for k, x in enumerate(v) if k not in inner] for v in (ends, scores))
    last = end
    while last > start and text[last - 1] in BLANKS:
        last -= 1
    if not ends or ends[-1] < last:
        ends.append(last)
        scores.append(1.0)
    # Every start is tried that could still win: no span scores more than its end, so a start whose best path is not
    # above ``top - s`` is passed over, together with all starts up to the next better one (``better``).
    best, back, better = [0.0], [-1], [-1]
    begins = [start, *ends]
    off = balance(text, begins)
    for j, (e, s) in enumerate(zip(ends, scores)):
        top, arg, at = float("-inf"), 0, j
        while at >= 0:
            i = at
            if best[i] + s <= top:
                at = better[i]
                continue
            at -= 1
            b = begins[i]
            while b < e and text[b] in BLANKS:
                b += 1
            if b >= e:
                continue
            size = e - b
            v = best[i] + s - 4.0 * min(off(i, j + 1), 2)
            if size < 3:
                v -= 3.0
            elif size > 600:
                v -= 0.5
            if text[b] in CLOSERS and text[b] not in "\"'“‘":
                v -= 4.0
            if v > top:
                top, arg = v, i
        best.append(top)
        back.append(arg)
        k = j
        while k >= 0 and best[k] <= top:
            k = better[k]
        better.append(k)
    out, j = [], len(ends)
    while j > 0:
        out.append(ends[j - 1])
        j = back[j]
    return out[::-1]


def units(text: str) -> list[int]:
    """1-based position of the last character of each unit of ``text``."""
    out: list[int] = []
    lines, at = [], 0
    for line in re.split(r"(\r\n|\n|\r)", text):
        if line in ("\n", "\r\n", "\r"):
            at += len(line)
            continue
        lines.append((at, at + len(line), line))
        at += len(line)
    block: list[tuple[int, int, str]] = []

    def prose(a: int, b: int) -> None:
        if text[a:b].strip(BLANKS):
            out.extend(spans(text, a, b))

    def flush() -> None:
        if not block:
            return
        kinds: list[str] = []
        for k, (_, _, line) in enumerate(block):
            before = kinds[-1] if kinds else ""
            alone = before in ("", "heading", "label", "rule")
            if HEADING.match(line):
                kind = "heading"
            elif RULE.match(line):
                kind = "rule"
            elif BULLET.match(line) and (alone or before in ("item", "more") or block[k - 1][2].rstrip()[-1] in ".!?:。！？"):
                kind = "item"
            elif NUMBERED.match(line) and (alone or before in ("item", "more") or block[k - 1][2].rstrip()[-1] == ":"):
                kind = "item"
            elif LABEL.match(line) and alone and not (len(line) > 60 and k + 1 < len(block) and not LABEL.match(block[k + 1][2])):
                kind = "label"
            elif before in ("item", "more"):
                kind = "more"
            else:
                kind = "prose"
            kinds.append(kind)
        k = 0
        while k < len(block):
            a, b = block[k][0], block[k][1]
            if kinds[k] == "prose":
                while k + 1 < len(block) and kinds[k + 1] == "prose":
                    k += 1
                prose(a, block[k][1])
            else:
                while kinds[k] in ("item", "more") and k + 1 < len(block) and kinds[k + 1] == "more":
                    k += 1
                b = block[k][1]
                while b > a and text[b - 1] in BLANKS:
                    b -= 1
                if kinds[k] != "rule" or b > a:
                    out.append(b)
            k += 1
        block.clear()

    for line in lines:
        if line[2].strip(BLANKS):
            block.append(line)
        else:
            flush()
    flush()
    return out


def split_sentences(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, end_pos`` (1-based, in code points) of every unit; with ``with_text`` also ``unit_index, text``.

    Null and blank texts and null ids give no rows; a repeated doc_id counts once; other columns are ignored. A text
    without any mark or blank line is one unit, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends, numbers, texts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, before = units(text), 0
                ids += [doc] * len(found)
                ends += found
                if with_text:
                    for k, e in enumerate(found):
                        numbers.append(k)
                        texts.append(text[before:e].strip(BLANKS))
                        before = e
            more = [pa.array(numbers, pa.int32()), pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32()), *more], names=["doc_id", "end_pos", *["unit_index", "text"][: len(more)]])

    schema = "doc_id long, end_pos int" + (", unit_index int, text string" if with_text else "")
    rows = documents.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, schema).dropDuplicates(["doc_id", "end_pos"])
