"""Repair of text read from scanned pages.

Every line of a page is labelled by a hidden Markov model: header, page number, first line of a paragraph, one that goes
on, break, or the label or value of a form. Its symbols are layout features: the place on the page, whether the line looks like a title, a sentence or
a form label, whether it carries the page's own number, whether the same line, with misread letters and numbers folded
away, stands outside the sentences of at least three pages of the file, how the line opens, and how full and how ended
the line before it is. Its probabilities are counted on drawn pages (``drawn_pages``). Headers and page numbers are
dropped, and paragraphs are put together as labelled.

Words are judged by the corpus itself: how many pages hold a word, within lines, tells a broken word from a compound
broken at its own hyphen, and a misread word from an ordinary one. The counts are kept in a table of fixed size.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sketch import slot

# Characters and pairs that scanners confuse, wrong one first.
SINGLE = {"0": "o", "1": "l", "5": "s", "8": "b", "6": "g", "!": "i", "†": "t", "@": "a", "$": "s", "€": "e", "|": "l", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
DOUBLE = (("c", "e"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("u", "ii"), ("e", "c"), ("ri", "n"), ("nn", "m"))
HYPHENS = "-‐‑\xad"
#: A word counts as known from this number of pages on. Slots of the table of counts, and steps of it to a doubling.
LEAST_PAGES, SLOT_BITS, STEPS = 4, 22, 8

BROKEN = re.compile(rf"(?<=[^\W\d_])([{HYPHENS}])[ \t\r]*\n[ \t]*(?=[^\W\d_])")
TOKEN_END, TOKEN_START = re.compile(r"[^\W\d_]+$"), re.compile(r"([^\W\d_]+)(\S*)")
STRIP = ".,;:()[]{}\"'“”„»«‘’?…*#<>—–"
ODD = re.compile(r"[\d_.:+/\\=%&~^]")
LETTERS = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)*")
PAGE_WORD = r"(?:page|pg\.?|p\.|seite|s\.|página|pág\.|стр\.|страница|folio|sheet)"
NUMBER_LINE = re.compile(rf"^\W*{PAGE_WORD}?\s*(\d+)(?:\s*(?:/|of|von|de|sur|из)\s*\d+)?\W*$", re.I)
NUMBER_TAIL = re.compile(rf"(?:\s{{2,}}|\s*[|·•/—–-]\s*|\s+(?={PAGE_WORD}))\W*{PAGE_WORD}?\s*(\d+)(?:\s*(?:/|of|von|de|sur|из)\s*\d+)?\W*$", re.I)
NUMBER_HEAD = re.compile(rf"^\W*{PAGE_WORD}?\s*(\d+)(?:\s*(?:/|of|von|de|sur|из)\s*\d+)?(?:\s{{2,}}|\s*[|·•/—–]\s*)", re.I)
LABEL = re.compile(r"^[^\W\d_][^.!?|\d]{1,38}$")
LABEL_VALUE = re.compile(r"^[^\W\d_][^.!?:|]{1,30}:\s")


# --- words ---------------------------------------------------------------------------------------------------------


def words_of(text: str) -> set[str]:
    """Lower-case ordinary words and compounds that stand whole within a line."""
    out = set()
    for line in text.split("\n"):
        parts = line.split()
        if parts and parts[-1][-1] in HYPHENS:
            parts.pop()
        for p in parts:
            w = p.strip(STRIP)
            if len(w) > 2 and w[0].islower() and w.isalpha() or "-" in w and LETTERS.fullmatch(w):
                out.add(w.lower())
    return out


class Pages:
    """How many pages hold each known word, to within a tenth, in a table of fixed size.

    Words whose hashes fall into one slot share the count of the more frequent. As words are judged by large ratios of
    counts, the small counts that most words have do little harm to one another, however many words there are.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> Pages:
        table = np.zeros(1 << SLOT_BITS, np.uint8)
        for w, n in counts.items():
            table[slot(w, SLOT_BITS)] = max(table[slot(w, SLOT_BITS)], round(np.log2(n) * STEPS) + 1)
        return cls(table)

    def get(self, word: str, default: int = 0) -> int:
        n = self.known.get(word)
        if n is None:
            step = int(self.table[slot(word, SLOT_BITS)])
            n = round(2 ** ((step - 1) / STEPS)) if step else 0
            if len(self.known) < 500_000:
                self.known[word] = n
        return n or default

    def __getitem__(self, word: str) -> int:
        return self.get(word)

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0

    def __reduce__(self):
        return Pages, (self.table,)


def vocabulary(segments: DataFrame) -> Pages:
    """Pages on which each word stands that ``LEAST_PAGES`` or more hold. At most ``2 ** SLOT_BITS`` rows of a slot and
    a byte reach the driver, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > 300_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    def out(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([slot(w, SLOT_BITS) for w in counts], pa.int32()), pa.array([*counts.values()], pa.int64())], names=["word", "slot", "pages"])

    counts = segments.select("text").where("text is not null").mapInArrow(run, "word string, slot int, pages long").groupBy("slot", "word").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    rows = counts.groupBy("slot").agg((F.round(F.log2(F.max("pages")) * STEPS) + 1).cast("short").alias("step")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[rows["slot"].to_numpy()] = rows["step"].to_numpy()
    return Pages(table)


class Words:
    """Judges words by the pages they stand on."""

    def __init__(self, known: Pages, ratio: int = 8, known_ratio: int = 40):
        # a misreading that is common enough to be known itself must be far rarer than the word it stands for
        self.known, self.ratio, self.known_ratio, self.memo = known, ratio, known_ratio, {}
        self.judged: dict[str, tuple[str, str] | None] = {}

    def read_as(self, token: str) -> str | None:
        """The ordinary word that a misread token stands for, in lower case, or None."""
        t = token.lower()
        if t not in self.memo:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[t] = self._read_as(t)
        return self.memo[t]

    def _read_as(self, t: str) -> str | None:
        if len(t) < 3 or len(t) > 40:
            return None
        own = self.known.get(t, 0)
        folds = {t}
        for wrong, right in SINGLE.items():
            if wrong in t:
                folds = {f.replace(wrong, right) for f in folds} | ({f.replace("1", "i") for f in folds} if wrong == "1" else set())
        folded = folds - {t}
        if any(c.isdigit() for f in folded for c in f) or sum(c.isalpha() for c in t) < 2:
            return None
        best = max((f for f in folded if self.known.get(f, 0) > 2 * own), key=lambda f: self.known[f], default=None)
        if best:
            return best
        front, least = (folded or {t}), max(own, 1) * (2 if folded else self.known_ratio if own else self.ratio)
        for _ in range(2):
            back = set()
            for f in front:
                for wrong, right in DOUBLE:
                    at = f.find(wrong)
                    while at >= 0:
                        back.add(f[:at] + right + f[at + len(wrong) :])
                        at = f.find(wrong, at + 1)
            best = max((f for f in back if self.known.get(f, 0) >= least), key=lambda f: self.known[f], default=None)
            if best:
                return best
            if own or len(t) < 5:
                return None
            front = back
        return None

    def misread(self, raw: str) -> tuple[str, str] | None:
        """(wrong, right) for a token as it stands between blanks, or None."""
        if raw not in self.judged:
            if len(self.judged) > 300_000:
                self.judged.clear()
            self.judged[raw] = self._misread(raw)
        return self.judged[raw]

    def _misread(self, raw: str) -> tuple[str, str] | None:
        w = raw.strip(STRIP)
        if not w or w.isdigit():
            return None
        bare = w.strip("!|")
        if bare != w and bare.lower() in self.known or not any(c.isalpha() for c in w):
            return None
        if ODD.search(w.translate(_FOLD)) or w.count("@") > 1 and len(w) < 6:
            return None
        caps = sum(c.isupper() for c in w)
        if caps > 1 and caps < sum(c.isalpha() for c in w) - 1:
            return None
        for part in (w, bare) if bare != w else (w,):
            if "-" in part:
                continue
            if part and (right := self.read_as(part)):
                return part, right
        for part in w.split("-") if "-" in w else ():
            if part and part.lower() not in self.known and (right := self.read_as(part)) and not part[0].isupper():
                return part, right
        return None

    def broken(self, before: str, left: str, right: str, after: str) -> bool:
        """Whether the hyphen between two lines is none of the word's own."""
        if after[:1] in SINGLE and self.read_as((left + right + after).strip(STRIP)):
            return True
        if right[0].isupper() and not left.isupper() or re.search(r"[@\d_/]", before + after) or re.search(r"\w\.\w", before + after):
            return False
        join, own = (left + right).lower(), f"{before.strip(STRIP)}{left}-{right}".lower()
        kj, ko = self.known.get(join, 0), max(self.known.get(own, 0), self.known.get(f"{left}-{right}".lower(), 0))
        if after[:1] == "-":
            ko = max(ko, self.known.get(own + after.rstrip(STRIP).lower(), 0))
        if kj or ko:
            return kj > ko
        if self.read_as(join):
            return True
        return not (left.lower() in self.known and right.lower() in self.known and len(left) > 2 and len(right) > 2)


_FOLD = str.maketrans(dict.fromkeys("0158", "x") | {"6": "x"})


# --- lines ---------------------------------------------------------------------------------------------------------


def folded(line: str) -> str:
    """A line with blanks, case and the letters that scanners confuse folded away."""
    line = " ".join(line.lower().split())
    for wrong, right in (*SINGLE.items(), *DOUBLE[:6]):
        line = line.replace(wrong, right)
    return line


def line_symbol(line: str, before: str, page: int | None) -> tuple[str, str | None]:
    """Symbol of a line, and the text, without number, under which a title-like one may recur.

    ``b`` blank, ``p`` the page's own number alone, ``v`` the same behind a label, ``s`` sentence, table row, list item
    or form line, ``t`` title-like, ``n`` title-like with the page's own number.
    """
    s = line.strip()
    if not s:
        return "b", None
    own = str(page) if page is not None else None
    numbers = own is not None and own in s
    if numbers and (m := NUMBER_LINE.match(s)) and own == m[1].lstrip("0"):
        return ("v" if s.isdigit() and LABEL.match(before.strip()) and before.strip()[0].isupper() else "p"), None
    if len(s) > 110 or s[0] in "|-*•#" or s[-1] in ".,;:!?。、" + HYPHENS and not s.endswith(")"):
        return "s", None
    rest = s
    numbered = False
    for pattern in (NUMBER_TAIL, NUMBER_HEAD) if numbers else ():
        if (m := pattern.search(s)) and m[1].lstrip("0") == own and len(r := (s[: m.start()] + s[m.end() :]).strip(" |·•—–-")) > 3:
            rest, numbered = r, True
            break
    if re.fullmatch(r"[\W\d]*", rest) or not re.search(r"[^\W\d_]{3}", rest):
        return "s", None
    return ("n" if numbered else "t"), rest


STATES = ("header", "number", "first", "more", "break", "label", "value")
HEADER, NUMBER, FIRST, MORE, BREAK, FIELD, VALUE = range(7)
#: Symbols of lines that can be page furniture.
MARGIN = "bpnt"


def read_page(text: str, page: int | None) -> tuple[str, str, list[str | None]]:
    """Symbol, cue and key of every line of a page.

    The cue is a letter for how the line opens (small letter, capital, number, item mark), how full the text line before
    it is, and whether that one ends a sentence. Keys are given outside the page's sentences only, where furniture can
    stand: before the first and behind the last line that is one.
    """
    lines = text.split("\n")
    symbols, cues, keys = [], [], []
    width = max(map(len, lines))
    before, last = "", ""
    for line in lines:
        s, key = line_symbol(line, last, page)
        line = line.strip()
        opens = 3 if line[:1] in ("|", "#", "*", "•", "-") and line[1:2] in (" ", "#") or LABEL_VALUE.match(line) else 0 if line[:1].islower() else 1 if not line[:1].isdigit() else 2
        full = 0 if not before else 1 if len(before) < 0.6 * width or width < 45 else 2
        cues.append(chr(65 + opens * 6 + full * 2 + (before[-1:] in ".!?:。！？।") if line else 90))
        symbols.append(s), keys.append(key)
        last = line
        before = line if s != "p" else before
    inner = [i for i, s in enumerate(symbols) if s not in MARGIN]
    if inner:
        keys[inner[0] : inner[-1] + 1] = [None] * (inner[-1] + 1 - inner[0])
    return "".join(symbols), "".join(cues), [k and folded(k) for k in keys]


def placed(symbols: str) -> list[str]:
    """Symbols with their place: outermost line of the page (0), behind nothing but furniture (1), or inside (2)."""
    n = len(symbols)
    out = [""] * n
    for order in (range(n), range(n - 1, -1, -1)):
        state = "0"
        for i in order:
            s = symbols[i]
            out[i] = min(out[i] or "2", state)
            if s != "b":
                state = max(state, "1") if s in "pNTn" else "2"
    return [s + p for s, p in zip(symbols, out)]


def drawn_pages(count: int = 3000, seed: int = 5) -> list[tuple[str, str, list[int]]]:
    """Labelled pages: placed-to-be symbols (capitals for lines that recur in the file), cues, and the state of each line.

    A page has furniture above and below or not, and between it headings, wrapped paragraphs, lists, forms and tables.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    out = []
    for _ in range(count):
        page, width = rng.randint(1, 90), rng.randint(48, 100)
        body: list[tuple[str, int, bool]] = []  # line, state, whether it recurs

        def paragraph() -> None:
            text = " ".join(words(rng.randint(4, 12)).capitalize() + rng.choice("....?") for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.15:
                body.append((text, FIRST, False))
                return
            line, state = "", FIRST
            for w in text.split():
                if line and len(line) + len(w) + 1 > width:
                    if len(w) > 5 and rng.random() < 0.3 and len(line) + 4 < width:
                        line, w = f"{line} {w[:3]}-", w[3:]
                    body.append((line, state, False))
                    line, state = w, MORE
                else:
                    line = f"{line} {w}".strip()
            body.append((line, state, False))

        def form() -> None:
            recurs = rng.random() < 0.5  # the labels of a form stand on many pages of a file
            for _ in range(rng.randint(2, 7)):
                label, value = words(rng.randint(1, 2)).capitalize(), rng.choice([words(2).title(), str(rng.randint(1, 99)), str(page), f"{rng.randint(1, 99)},{rng.randint(100, 999)}"])
                if rng.random() < 0.5:
                    body.append((f"{label}: {value}", FIRST, False))
                else:
                    body.append((label, FIELD, recurs)), body.append((value, VALUE, False))

        def listed() -> None:
            for _ in range(rng.randint(2, 6)):
                body.append((rng.choice(["- ", "* ", "• "]) + words(rng.randint(2, 6)), FIRST, False))

        for _ in range(rng.randint(1, 4)):
            if body and rng.random() < 0.7:
                body += [("", BREAK, False)] * rng.randint(1, 2)
            if rng.random() < 0.25:
                body.append((rng.choice(["# ", ""]) + words(rng.randint(1, 4)).title(), FIRST, rng.random() < 0.05))
                if rng.random() < 0.5:
                    body.append(("", BREAK, False))
            rng.choice([paragraph, paragraph, paragraph, paragraph, form, listed])()
        head, number, at_top, number_top = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.6, rng.random() < 0.3
        together = head and number and at_top == number_top and rng.random() < 0.6
        folio = rng.choice([f"{page}", f"Page {page}", f"- {page} -", f"p. {page}", f"{page} / 90"])

        def furniture(has_head: bool, has_number: bool) -> list[tuple[str, int, bool]]:
            lines = []
            for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 2, 3, 4]) if has_head and not together else int(has_head)):
                title = words(rng.randint(1, 3)).title()
                title = rng.choice([title, title.lower(), title.upper(), f"{title} {words(2)}", f"{title}: {words(2).title()}", f"{words(2)} {rng.randint(1, 3000)}: {title}", f"{title} — {words(2)}", f"{title} / {words(1)}", f"{title} | {words(2)}", f"{title} (rev. {rng.choice('ABC')})", f"{rng.randint(1, 30)}. {title}"])
                lines.append((title + (rng.choice(["  ", " | ", " - ", " · "]) + folio if together else ""), HEADER, rng.random() < 0.95))
            if has_number and not together:
                lines.append((folio, NUMBER, False))
            rng.shuffle(lines)
            return lines

        top, low = furniture(head and at_top, number and number_top), furniture(head and not at_top, number and not number_top)
        gap = lambda: [("", BREAK, False)] * (rng.random() < 0.5)
        lines = top + (gap() if top else []) + body + (gap() if low else []) + low
        symbols, cues, keys = read_page("\n".join(l for l, _, _ in lines), page)
        out.append(("".join(c.upper() if recurs and k else c for c, k, (_, _, recurs) in zip(symbols, keys, lines)), cues, [x for _, x, _ in lines]))
    return out


class LineModel:
    """Hidden Markov model over all lines of a page; a line shows a symbol with its place, and a cue."""

    def __init__(self, pages: list[tuple[str, str, list[int]]] | None = None):
        pages = drawn_pages() if pages is None else pages
        n = len(STATES)
        start, end, move = np.ones(n), np.ones(n), np.full((n, n), 0.5)
        emit, hint = [Counter() for _ in STATES], [Counter() for _ in STATES]
        for symbols, cues, states in pages:
            start[states[0]] += 1
            end[states[-1]] += 1
            for a, b in zip(states, states[1:]):
                move[a, b] += 1
            for s, c, x in zip(placed(symbols), cues, states):
                emit[x][s] += 1
                hint[x][c] += 1
        share = lambda counts: {k: np.array([np.log((c[k] + 0.02) / (c.total() + 0.02 * len(seen))) for c in counts], np.float32) for seen in [set().union(*counts)] for k in seen}
        self.start, self.end, self.move = np.log(start / start.sum()), np.log(end / end.sum()), np.log(move / move.sum(1, keepdims=True))
        self.emit, self.hint = share(emit), share(hint)
        self.other = np.full(n, -6.0, np.float32)
        self.memo: dict[tuple[str, str], np.ndarray] = {}

    def _shown(self, s: str, c: str) -> np.ndarray:
        if (s, c) not in self.memo:
            self.memo[s, c] = self.emit.get(s, self.other) + self.hint.get(c, self.other)
        return self.memo[s, c]

    def label(self, pages: list[tuple[str, str]]) -> list[np.ndarray]:
        """The most likely states (Viterbi) of the lines of several pages of symbols and cues."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        for k in range(0, len(order), 256):
            own = order[k : k + 256]
            sizes = np.array([len(pages[i][0]) for i in own])
            rows = np.zeros((len(own), sizes[-1], len(STATES)), np.float32)
            for r, i in enumerate(own):
                rows[r, : sizes[r]] = [self._shown(s, c) for s, c in zip(placed(pages[i][0]), pages[i][1])]
            score, back = self.start + rows[:, 0], np.zeros((sizes[-1], len(own), len(STATES)), np.int8)
            for t in range(1, sizes[-1]):
                step = score[:, :, None] + self.move
                on = (t < sizes)[:, None]
                back[t] = np.where(on, step.argmax(1), np.arange(len(STATES)))
                score = np.where(on, step.max(1) + rows[:, t], score)
            states = np.empty((sizes[-1], len(own)), np.int64)
            states[-1] = (score + self.end).argmax(1)
            for t in range(sizes[-1] - 1, 0, -1):
                states[t - 1] = back[t][np.arange(len(own)), states[t]]
            for r, i in enumerate(own):
                out[i] = states[: sizes[r], r]
        return out


def labelled(segments: DataFrame) -> DataFrame:
    """``document_id, header, page_number, states``: whether a page carries furniture, and the state of each line."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, source, *read_page(text, page)) for doc, source, page, text in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            rows = [(doc, source, symbols, cues, sorted({k for k in keys if k}), keys) for doc, source, symbols, cues, keys in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())))] + [pa.array([[r[4].index(k) if k else -1 for k in r[5]] for r in rows], pa.list_(pa.int32()))],
                names=["document_id", "source_name", "symbols", "cues", "keys", "of"],
            )

    pages = segments.where("text is not null and document_id is not null").select("document_id", F.coalesce("source_name", F.lit("")), "page_number", "text")
    at = cut(pages.mapInArrow(edges, "document_id string, source_name string, symbols string, cues string, keys array<string>, of array<int>").dropDuplicates(["document_id"]))
    keys = at.select("document_id", "source_name", F.explode("keys").alias("key"))
    often = keys.groupBy("source_name", "key").agg(F.count("*").alias("pages")).where("pages >= 3").drop("pages")
    known = keys.join(often, ["source_name", "key"], "left_semi").groupBy("document_id").agg(F.collect_list("key").alias("often"))  # of one page's lines

    model = segments.sparkSession.sparkContext.broadcast(LineModel())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, symbols, cues, keys, of, often = (batch.column(i).to_pylist() for i in range(6))
            shown = []
            for s, k, at, o in zip(symbols, keys, of, often):
                recurs = {k.index(x) for x in o} if o else ()
                shown.append("".join(c.upper() if i in recurs else c for c, i in zip(s, at)) if recurs else s)
            states = model.value.label(list(zip(shown, cues)))
            header = [any(c in "TN" and x == HEADER for c, x in zip(s, y)) for s, y in zip(shown, states)]
            number = [any(c == "p" and x == NUMBER or c in "Nn" and x == HEADER for c, x in zip(s, y)) for s, y in zip(shown, states)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(header, pa.bool_()), pa.array(number, pa.bool_()), pa.array(["".join(map(str, y)) for y in states], pa.string())], names=["document_id", "header", "page_number", "states"])

    return at.join(known, "document_id", "left").select("document_id", "symbols", "cues", "keys", "of", "often").mapInArrow(decide, "document_id string, header boolean, page_number boolean, states string")


# --- pages ---------------------------------------------------------------------------------------------------------


def mend(text: str, words: Words) -> tuple[str, bool, bool]:
    """Text with broken words joined and misread words put right; whether it had broken and misread ones."""
    hyphened = False

    def join(m: re.Match) -> str:
        nonlocal hyphened
        at = m.start()
        while at > 0 and not m.string[at - 1].isspace():
            at -= 1
        token = m.string[at : m.start()]
        left = TOKEN_END.search(token)[0]
        right, after = TOKEN_START.match(m.string, m.end()).groups()
        if words.broken(token[: len(token) - len(left)], left, right, after):
            hyphened = True
            return ""
        return "" if m[1] == chr(0xAD) else "-"

    if any(h + e in text for h in HYPHENS for e in ("\n", " ", "\t", "\r")):
        text = BROKEN.sub(join, text)
    wrong = {}
    for raw in set(text.split()):
        if hit := words.misread(raw):
            wrong[hit[0]] = hit[1]
    for w, r in wrong.items():
        r = r.upper() if w.isupper() and len(w) > 2 else r[0].upper() + r[1:] if w[0].isupper() else r
        text = re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", lambda _, r=r: r, text)
    return text, hyphened, bool(wrong)


def paragraphs(text: str, states: str | None, words: Words) -> tuple[str, bool, bool]:
    """Continuous paragraphs of a page as its lines are labelled: furniture dropped, words mended, hard line ends undone."""
    lines = text.split("\n")
    labels = [int(x) for x in states] if states else [FIRST if l.strip() else BREAK for l in lines]
    kept = [(l, x) for l, x in zip(lines, labels) if x not in (HEADER, NUMBER)]
    blocks: list[list[str]] = []
    open_ = False
    for line, x in kept:
        if not line.strip():
            open_ = False
        elif x == MORE and open_:
            blocks[-1].append(line)
        else:
            blocks.append([line])
            open_ = True
    out, hyphened, misread = [], False, False
    for b in blocks:
        mended, h, m = mend("\n".join(b), words)
        out.append(" ".join(mended.split()))
        hyphened, misread = hyphened or h, misread or m
    return "\n\n".join(out), hyphened, misread


def repair(segments: DataFrame, with_text: bool = True) -> DataFrame:
    """``document_id, text, noise`` of the scanned pages: repaired text and an array of the kinds of noise found.

    Kinds: ``hyphenation``, ``misread``, ``header``, ``page_number``. Only PDF pages are repaired. A document id counts
    once, a null id or text takes no part, a page without number has no furniture; other columns are ignored.
    ``with_text=False`` leaves the text out (null).
    """
    pages = segments.where("file_type = 'pdf' and document_id is not null and text is not null")
    known = pages.sparkSession.sparkContext.broadcast(vocabulary(pages))
    marks = labelled(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(known.value)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = []
            for doc, text, *more in zip(*columns):
                new, hyphened, misread = paragraphs(text, more[0], words) if with_text else (None, *mend(text, words)[1:])
                rows.append((doc, new, hyphened, misread))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["document_id", "text", "hyphenation", "misread"]
            )

    schema = "document_id string, text string, hyphenation boolean, misread boolean"
    if with_text:
        marks = cut(marks)
        both = pages.select("document_id", "text").join(marks.select("document_id", "states"), "document_id", "left").mapInArrow(run, schema)
    else:
        both = pages.select("document_id", "text").mapInArrow(run, schema)
    out = both.dropDuplicates(["document_id"]).join(marks.drop("states"), "document_id", "left")
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(k, F.lit(False)), k) for k in ("hyphenation", "misread", "header", "page_number")]))
    return out.select("document_id", "text", kinds.alias("noise"))


def found(segments: DataFrame) -> DataFrame:
    """``document_id, noise``, one row for each kind in a page."""
    return repair(segments, with_text=False).select("document_id", F.explode("noise").alias("noise"))
