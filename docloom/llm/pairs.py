"""Defects of request and response pairs.

Copies are found by compression: with the request as zstandard dictionary, a response that only gives it back shrinks to
next to nothing, whatever its case and marks, and so does the request with the response as dictionary. Refusals and
languages come from dictionaries of words, and broken-off endings from a terminal-context model: how often a word closes
a sentence or a list item, and a logistic model over what stands at the end, both fitted on all responses, whole and cut
off at random. Words and ends are counted where the responses lie; the driver sees sums of fixed size only.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Log odds of a response that breaks off before anything is known of it. (It is fitted on as many cut as whole ones.)
PRIOR = -1.0

MARK = re.compile(r"[\[(【]\s*(?:source|sources|src|quelle|fuente|источник)?\s*:?\s*\d+(?:\s*[,;]\s*\d+)*\s*[\])】]", re.I)
QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
TERMINAL = ".!?…。！？।॥؟۔"
CLOSING = "\"'”’»“)]}」』）】*_"
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』"}
ITEM = re.compile(r"^[ \t]*(?:[-*•–]|\d{1,3}[.)])(?:[ \t]+|$)(.*)$")

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in and is are was were be been by for with on at as it its this that these those from than or but not no what which who when where why how does do did can will must should each every both most few their there has have had only under after before because unless while instead i you my your me please",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war waren wird wurde werden wurden nicht mit für von zu zum zur im in am auf aus bei nach vor über unter was wer wie wann wo warum welche welcher welches bitte es sich auch als oder aber sowie ich sie wir steht nennt hat haben bleibt alles sobald gebe kann darf ohne laut seit bekommt mehr alle jede jeder keine kein nur noch schon",
    "fr": "le la les un une des du de au aux et est sont était sera fut furent dans sur pour par avec sans ne pas que qui quoi quand où comment pourquoi quel quelle quels quelles ce cette ces il elle on nous vous je son sa ses leur tout rien sauf malgré puis dit a été s'il plaît reste depuis avant en peux",
    "es": "el la los las un una unos unas de del al y es son fue fueron será está están queda quedó quedaron en con por para sin no que qué quién cuándo dónde cómo cuál por favor se su sus lo este esta estos todo salvo luego según desde antes indica tiene a",
}
# Names of languages in requests.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés ingles английский",
    "de": "german deutsch deutsche allemand alemán aleman немецкий",
    "fr": "french französisch franzosisch français francais francés frances французский",
    "es": "spanish spanisch espagnol español espanol castellano испанский",
    "ru": "russian russisch russe ruso русский русском по-русски",
    "zh": "chinese mandarin chinesisch chinois chino 中文 汉语 китайский",
    "ja": "japanese japanisch japonais japonés 日本語 японский",
    "th": "thai thailändisch thaï tailandés ไทย",
    "hi": "hindi हिन्दी हिंदी",
}
# Words of declining, by part they play.
SELF = r"(?:i|i'm|i’m|i'd|i’d|i've|i’ve|i'll|i’ll|me|my|we|us|our|ich|mir|mich|wir|je|j'|j’|nous|moi|me|yo|nos|mi|mis)"
DECLINE = (
    r"declin\w*|refus\w*|have to pass|must pass|will pass|pass on (?:this|that)|off[- ]limits|unanswered|leave (?:this|that|it)|denied|deny|(?:not|\w+n['’]t|cannot|cant|never|unable|rather not|won't|won’t)"
    r"|against my|guidelines|polic(?:y|ies)|permitted|allowed|appropriate|not to (?:talk|discuss|say)|elsewhere|no comment|no reply|uncomfortable|comfortable"
    r"|nicht|kein\w*|ablehn\w*|lehne|verweiger\w*|leider|ne (?:\w+ ){0,3}(?:pas|rien|point)|refuser|refuse|décline|impossible|no puedo|no podemos|no debo|rechaz\w*|declin\w*|negar\w*|prefiero no|no (?:me )?(?:es|está|esta|resulta) (?:posible|permitid\w*)|no estoy|no voy|permitid\w*|passen"
)
ACT = (
    r"answer\w*|respon\w*|repl(?:y|ies)|say\w*|speak\w*|discuss\w*|talk\w*|help\w*|assist\w*|compl(?:y|ies)|comment\w*|detail\w*|information|topic\w*|request\w*|question\w*|go into|provide\w*|share\w*|one|that|this|such|more"
    r"|beantwort\w*|auskunft|sag\w*|helfen|frage\w*|anfrage|thema|antwort\w*|äußer\w*|répon\w*|dire|aider|demande|question|sujet|renseign\w*|commenter|respuesta|contest\w*|decir|ayudar\w*|pregunta|solicitud|tema|informaci\w*|coment\w*"
)
IMPERSONAL = (
    r"\b(?:request|question|topic|query)\b[^.!?]*\b(?:denied|declined|refused|unanswered|off[- ]limits|not (?:something|permitted|allowed|possible))\b|\bno (?:comment|reply|answer)\b[^.!?]*\b(?:possible|here|from|on|side|given)\b|\bno comment\b"
    r"|\b(?:keine auskunft|kein kommentar|keine antwort)\b|\b(?:pas|aucun) (?:de )?(?:commentaire|réponse)\b|\b(?:sin comentarios|ningún comentario|no hay respuesta)\b"
)
# Words of declining that need no object.
STRONG = r"declin\w*|refus\w*|comply|off[- ]limits|unanswered|(?:have to|must|will|muss|müssen) (?:\w+ )?(?:pass|passen)|refuser|rechaz\w*|ablehnen|lehne|verweiger\w*|prefiero no|préfère ne|lieber nicht"
SELF_RE, DECLINE_RE, ACT_RE, IMPERSONAL_RE = (re.compile(p if p.startswith(r"\b(") else rf"(?<!\w)(?:{p})(?!\w)", re.I) for p in (SELF, DECLINE, ACT, IMPERSONAL))
STRONG_RE = re.compile(rf"(?<!\w)(?:{STRONG})(?!\w)", re.I)
# Spanish verbs of the first person need no pronoun.
SELF_ENDING_RE = re.compile(r"(?<!\w)(?:no (?:puedo|debo|voy a|quiero|podemos|debemos)|prefiero no|tengo que (?:rechazar|negarme)|(?:debo|tengo que) (?:declinar|rehusar))(?!\w)", re.I)
COURTESY_RE = re.compile(
    r"anything else|something else|else (?:you|i)|can i |could i |may i |look up|please (?:contact|ask|try|check|reach)|contact |hope you understand|sorry|apolog|thank|understand|instead\?|bitte wenden|sonst noch|wende dich|wenden sie|puis-je|autre chose|adressez|contactez|merci|algo más|otra cosa|puedo ayudar|contacte|gracias|entschuldig|tut mir leid|désolé|lo siento",
    re.I,
)


def _of(*categories: str, but: str = "") -> re.Pattern[str]:
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x110000)) if unicodedata.category(c) in categories and c not in but) + "]+")


_HIDDEN, _FORMAT = _of("Cf", "Cc", but="\n\t"), _of("Cf")


@lru_cache(64)
def bare(text: str) -> str:
    """Text without source marks, outer blanks and invisible characters."""
    return _HIDDEN.sub("", MARK.sub(" ", text)).strip()


def is_empty(text: str | None) -> bool:
    return text is None or not any(unicodedata.category(c)[0] in "LN" for c in bare(text))


def language(text: str) -> tuple[str | None, float]:
    """Language by script, else by function words, and the evidence for it; None without a clear majority."""
    scripts: Counter[str] = Counter()
    for c in QUOTED.sub(" ", text):
        o = ord(c)
        if 0x3040 <= o <= 0x30FF:
            scripts["ja"] += 1
        elif 0x4E00 <= o <= 0x9FFF:
            scripts["han"] += 1
        elif 0x0E00 <= o <= 0x0E7F:
            scripts["th"] += 1
        elif 0x0900 <= o <= 0x097F:
            scripts["hi"] += 1
        elif 0x0400 <= o <= 0x04FF:
            scripts["ru"] += 1
        elif c.isalpha():
            scripts["latin"] += 1
    if not scripts:
        return None, 0
    top, n = scripts.most_common(1)[0]
    if top in ("han", "ja"):
        return ("ja" if scripts["ja"] > 0.1 * (scripts["ja"] + scripts["han"]) else "zh"), float(n)
    if top != "latin":
        return top, float(n)
    words = [w.lower() for w in WORD.findall(QUOTED.sub(" ", text))]
    score = {lang: sum(1 / _SHARED[w] for w in words if w in of) for lang, of in _FUNCTION.items()}
    first, second = sorted(score, key=score.get, reverse=True)[:2]
    return (first if score[first] >= 1 and score[first] > 1.5 * score[second] else None), score[first]


_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SHARED = Counter(w for v in _FUNCTION.values() for w in v)
_NAMES = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}


def asked_for(message: str) -> set[str]:
    """Languages that a request names."""
    return {_NAMES[w] for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", message.lower()) if w in _NAMES}


def is_other_language(message: str | None, text: str) -> bool:
    if not message:
        return False
    (a, sure_a), (b, sure_b) = language(message), language(bare(text))
    if a is None or b is None or a == b or sure_b < 1.5:
        return False
    return b not in asked_for(message)


#: Bytes that stand for a word, so that a new word costs the same whatever its length; bytes that zstandard needs to say
#: "the dictionary again"; words of a lead-in that a copy may add, and the share of the request's words that it may lose.
WORD_BYTES, AGAIN, LEAD_IN, LOST = 12, 16, 4, 0.1


def packed(text: bytes, dictionary: bytes | None = None) -> int:
    """Bytes of ``text`` under zstandard, with another text as dictionary."""
    import zstandard

    given = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_checksum=False).compress(text))


def coded(text: str) -> bytes:
    """The words of a text, in lower case, as codes of equal length."""
    return b"".join(xxhash.xxh3_128_digest(w.lower())[:WORD_BYTES] for w in WORD.findall(text))


def new_words(text: bytes, dictionary: bytes) -> float:
    """About how many words of a coded text its dictionary does not hold, by what is left of it under compression."""
    return max(packed(text, dictionary) - AGAIN, 0) / WORD_BYTES


def is_copy(message: str | None, text: str) -> bool:
    """Whether a response only gives its request back: with the request as dictionary there is no more new in it than a
    lead-in, and with the response as dictionary there is next to nothing new in the request."""
    if not message:
        return False
    asked, said = coded(message), coded(bare(text))
    if not asked or not said:
        return False
    return new_words(said, asked) <= LEAD_IN and new_words(asked, said) <= 0.3 + LOST * len(asked) / WORD_BYTES


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?…。！？])[\s\"”’»)]*\s+|\n+", text) if s.strip()]


def declines(sentence: str) -> bool:
    s = QUOTED.sub(" ", sentence)
    if IMPERSONAL_RE.search(s):
        return True
    return bool(SELF_RE.search(s) and (DECLINE_RE.search(s) and ACT_RE.search(s) or STRONG_RE.search(s)) or SELF_ENDING_RE.search(s))


def is_refusal(text: str) -> bool:
    """Whether the response as a whole declines: some sentence declines in the speaker's own name, and the others, if
    any, are courtesies or decline too."""
    parts = sentences(bare(text))
    flags = [declines(p) for p in parts]
    return any(flags) and all(f or (COURTESY_RE.search(p) is not None and len(p) < 140) or len(p.split()) < 3 for f, p in zip(flags, parts))


def ending(text: str) -> tuple[bytes, str]:
    """What stands at the end of a text, as small numbers, and its last word; the first number is 1.

    Those at ``_RATED`` still want the word's rate, those at ``_NEW`` hold only for a word that hardly occurs (``filled``).
    """
    raw = _FORMAT.sub("", text).rstrip()
    mark = re.search(r"[\[(【](?:s(?:o(?:u(?:r(?:ce?s?)?)?)?)?)?\s*:?\s*\d*$", raw, re.I) is not None
    s = bare(text)
    tail = s.rstrip(CLOSING + " \t\n")
    lines = s.split("\n")
    flat = re.sub(r"(?m)^\s*\d+\)", "", s)
    open_ = any(flat.count(a) > flat.count(b) for a, b in OPENERS.items())
    open_ = open_ or s.count("„") > s.count("“") + s.count("”") or "„" not in s and s.count("“") > s.count("”") or s.count("«") > s.count("»") and "»" not in s[: s.find("«") + 1]
    words = WORD.findall(lines[-1])
    last = words[-1] if words else ""
    w = last.lower()
    ends = bool(tail) and tail[-1] in TERMINAL
    wanting = ends and bool(lines[-1].split()) and lines[-1].split()[-1].lower() in _WANTING
    item = ITEM.match(lines[-1]) is not None
    others = [len(WORD.findall(m[1])) for l in lines[:-1] if (m := ITEM.match(l))] if item else []
    fewer = bool(others) and len(WORD.findall(ITEM.match(lines[-1])[1])) < min(others)
    script = ord(tail[-1]) if tail else 0
    unmarked = 0x0E00 <= script <= 0x0EFF or 0x1780 <= script <= 0x17FF or 0x1000 <= script <= 0x109F
    wide = 0x3040 <= script <= 0x9FFF or 0x0900 <= script <= 0x097F
    bare_end = not ends and not item and not unmarked and not wide  # a line of words without a closing mark
    new = w.isalpha() and last.islower()
    value = any(c.isdigit() for c in w) or last[:1].isupper() or w in _MEASURES
    said = sum(x in _ALL_FUNCTION for x in words if x.islower())
    several = len(sentences(s)) > 1
    return bytes([
        1, ends and not wanting, wanting, mark, open_, bool(s) and s[-1] in ",;:-–—/(&+=" and not item, not tail, item, item and fewer, item and new, item and w in _LAST_NEVER, item and not words, unmarked, wide, wide and len(tail) > 12,
        bare_end, bare_end and several, bare_end and len(words) > 7, bare_end and w in _LAST_NEVER, bare_end and new, bare_end and value, bare_end and value and len(words) > 4 and said > 0, bare_end and not value and len(words) > 1, bare_end and len(words) <= 1,
        bare_end and bool(words) and words[0] in _OPENING, bare_end, item, min(len(words), 12) * bare_end, min(said, 4) * bare_end, bare_end and len(words) <= 1 and new, bare_end and value and len(words) <= 2 and not several, bare_end and value and 2 < len(words) <= 4 and not several,
    ]), w


def filled(ends: np.ndarray, seen: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """The features of ``ends``, whose last words stand ``seen`` times, ``closes`` times at the end of a sentence."""
    x = ends * _SCALE
    x[:, _RATED] *= np.log((closes + 0.5) / (seen + 1))[:, None]
    x[:, _NEW] *= (seen < 2)[:, None]
    return x


class Counts:
    """Words and ends of texts: how often a word stands and closes a sentence; how often an end, with its last word,
    stands under whole texts (0) and under texts cut off at a place drawn from the text and its key (1)."""

    def __init__(self, seed: int = 5):
        self.seed = seed
        self.seen: Counter[str] = Counter()
        self.closes: Counter[str] = Counter()
        self.ends: Counter[tuple[bytes, str, int]] = Counter()

    def add(self, text: str, key: int) -> None:
        if is_empty(text):
            return
        for s in sentences(bare(text)):
            words = [w.lower() for w in WORD.findall(s)]
            self.seen.update(words)
            if words and s.rstrip(CLOSING + " ")[-1:] in TERMINAL:
                self.closes[words[-1]] += 1
        end, word = ending(text)
        # no example of a whole text: an open bracket or quotation, half a source mark, a comma or a hyphen at the end
        if not any(end[k] for k in _BREAKS):
            self.ends[end, word, 0] += 1
        if len(text) < 12:
            return
        r = random.Random(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), (key + self.seed) & (1 << 63) - 1))
        at = r.randint(min(6, len(text) // 2), len(text) - 2)
        if r.random() < 0.5 and (space := text.rfind(" ", 4, at)) > 0:
            at = space
        part = text[:at].rstrip()
        if not is_empty(part) and part.rstrip(CLOSING + " ")[-1:] not in TERMINAL:
            self.ends[(*ending(part), 1)] += 1


def sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the logistic loss at ``w`` over examples that stand ``n`` times; whole ones that
    looked cut under the weights ``before`` are left out."""
    if before is not None:
        keep = (y == 1) | (x @ before < 1.5)
        x, y, n = x[keep], y[keep], n[keep]
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (n * (p - y)), (x.T * (n * p * (1 - p))) @ x


def fitted(of: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights by Newton's method; ``of`` gives ``sums`` over all examples."""
    w, before = np.zeros(len(_SCALE)), None
    for _ in range(3):
        for _ in range(12):
            first, second = of(w, before)
            step = np.linalg.solve(second + 1e-2 * np.eye(len(w)), first + 1e-2 * w)
            w = w - step
            if np.abs(step).max() < 1e-4:
                break
        before = w
    return w


class Endings:
    """Terminal-context model: how often a word closes a sentence or list item, which words exist, and a logistic model
    over the features of a text's end, fitted on ``texts`` as they are and cut off at random places."""

    def __init__(self, texts: Iterable[str], seed: int = 5):
        self.counts, self.weights = Counts(seed), np.zeros(0)
        for key, text in enumerate(texts):
            self.counts.add(text, key)
        ends = self.counts.ends
        y, n = np.array([k[2] for k in ends], float), np.array(list(ends.values()), float)
        if y.any():
            x = self._filled([k[:2] for k in ends])
            self.weights = fitted(lambda w, before: sums(x, y, n, w, before))

    def _filled(self, ends: list[tuple[bytes, str]]) -> np.ndarray:
        seen, closes = (np.array([c[w] for _, w in ends], float) for c in (self.counts.seen, self.counts.closes))
        return filled(np.array([list(e) for e, _ in ends], float), seen, closes)

    def is_truncated(self, text: str) -> bool:
        """Whether the end of ``text`` is more like the ends of cut responses than like those of whole ones."""
        return len(self.weights) > 0 and float(self._filled([ending(text)])[0] @ self.weights) + PRIOR > 0


# Abbreviations that something must follow.
_WANTING = frozenset("e.g. i.e. fig. no. nos. vs. dr. mr. mrs. ms. prof. sec. p. pp. cf. approx. nr. abs. s. z.b. bzw. art. núm. pág. sr. sra.".split())
_MEASURES = frozenset("percent prozent hours days weeks months years minutes seconds pages euros dollars stunden tage wochen jahre heures jours semaines ans horas días semanas años por ciento cent".split())
_OPENING = frozenset("Almost Each Both Every Few Most Two Only Under After Before Because Unless While Instead Neither Once Should If Later According No".split())
# Words that no answer ends on.
_LAST_NEVER = frozenset(
    "the a an of to in and or but with by for from than that which who when where while if unless because as at on into their its his her our your is are was were be been has have had will can must should each every both"
    " der die das den dem des ein eine einen einem einer und oder mit von zu zum zur im am auf aus bei nach vor ist sind wird wurde und le la les un une des du de et ou avec sans pour par dans sur est sont sera fut que qui el los las unos del al y con por para en es son fue será que".split()
)


#: Features that no whole text has: a waiting abbreviation, half a source mark, something open, a comma or hyphen.
_BREAKS = [2, 3, 4, 5]
#: Features that want the last word's rate, those that want it to be new, and what each small number counts.
_RATED, _NEW = [25, 26], [9, 19, 29]
_SCALE = np.array([*[1.0] * 27, 1 / 12, 1 / 4, *[1.0] * 3])
_ALL_FUNCTION = frozenset().union(*_FUNCTION.values())


def counted(turns: DataFrame) -> DataFrame:
    """``word, end, y, n, closes`` over all responses: words (without end) stand ``n`` times and close ``closes``
    sentences; ends with their last word stand ``n`` times under whole (``y`` 0) or cut (1) responses."""

    def rows(counts: Counts) -> pa.RecordBatch:
        words = [(w, None, None, n, counts.closes[w]) for w, n in counts.seen.items()]
        ends = [(w, e, y, n, 0) for (e, w, y), n in counts.ends.items()]
        cols = zip(*words, *ends) if words or ends else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "end", "y", "n", "closes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.add(text, key)
            if len(counts.seen) + len(counts.ends) > 200_000:
                yield rows(counts)
                counts = Counts()
        yield rows(counts)

    texts = turns.where("cast(turn_id as long) is not null and text is not null").select(F.col("turn_id").cast("long").alias("turn_id"), "text").distinct()
    return texts.mapInArrow(run, "word string, end binary, y int, n long, closes long").groupBy("word", "end", "y").agg(F.sum("n").alias("n"), F.sum("closes").alias("closes"))


def weights(examples: DataFrame) -> np.ndarray:
    """Weights fitted over all of ``examples(end, y, n, seen, closes)``: each Newton step is one pass over them, of which
    every task gives its sums."""
    if not examples.where("y = 1").take(1):
        return np.zeros(0)

    def of(w: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                if batch.num_rows:
                    ends = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(w))
                    y, n, seen, closes = (batch.column(k).to_numpy().astype(float) for k in range(1, 5))
                    a, b = sums(filled(ends, seen, closes), y, n, w, before)
                    first, second = first + a, second + b
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = examples.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        total = np.zeros(len(w) * (len(w) + 1))
        for r in parts.collect():
            total[r["at"]] = r["v"]
        return total[: len(w)], total[len(w) :].reshape(len(w), -1)

    return fitted(of)


def find_defects(turns: DataFrame) -> DataFrame:
    """``turn_id, defect``: the first that fits of ``empty, copy, refusal, other_language, truncated``.

    ``turns`` needs ``turn_id, message, text``. A turn id counts once, a null id takes no part; a null request can
    neither be copied nor differ in language; other columns are ignored. The terminal-context model is fitted on all
    responses; without any it finds no truncated ones.
    """
    rows = turns.where("turn_id is not null").select("turn_id", "message", "text")
    known = cut(counted(rows))
    words = known.where("end is null").select("word", F.col("n").alias("seen"), "closes")
    none = F.lit(0).cast("long")
    examples = known.where("end is not null").select("word", "end", "y", "n").join(words, "word", "left")
    model = weights(cut(examples.select("end", "y", "n", F.coalesce("seen", none).alias("seen"), F.coalesce("closes", none).alias("closes"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, message, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                word = fixed = rated = new = None
                if is_empty(text):
                    kind = "empty"
                elif is_copy(message, text):
                    kind = "copy"
                elif is_refusal(text):
                    kind = "refusal"
                elif is_other_language(message, text):
                    kind = "other_language"
                elif len(model):
                    end, word = ending(text)
                    parts = np.frombuffer(end, np.uint8) * _SCALE * model
                    rated, new = float(parts[_RATED].sum()), float(parts[_NEW].sum())
                    fixed = float(parts.sum()) - rated - new + PRIOR
                    kind = "truncated"
                    if rated == new == 0:  # the last word does not matter
                        if fixed <= 0:
                            continue
                        word = None
                else:
                    continue
                out.append((i, kind, word, fixed, rated, new))
            kinds = (pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=["turn_id", "defect", "word", "fixed", "rated", "new"])

    told = rows.select(F.col("turn_id").cast("long").alias("turn_id"), "message", "text").mapInArrow(run, "turn_id long, defect string, word string, fixed double, rated double, new double")
    # rows without a word get keys of their own, so that they do not meet under one empty key
    keyed = told.withColumn("_key", F.coalesce("word", F.concat(F.lit(" "), F.col("turn_id").cast("string"))))
    seen, closes = F.coalesce("seen", none), F.coalesce("closes", none)
    score = F.col("fixed") + F.col("rated") * F.log((closes + 0.5) / (seen + 1)) + F.when(seen < 2, F.col("new")).otherwise(0.0)
    found = keyed.join(words.withColumnRenamed("word", "_key"), "_key", "left").where(F.col("word").isNull() | (score > 0))
    return found.select("turn_id", "defect").dropDuplicates(["turn_id"])


def by_mode(turns: DataFrame) -> DataFrame:
    """Turns and defects in each mode: ``mode, defect, turns`` (defect ``none`` for sound turns)."""
    of = turns.where("turn_id is not null").select("turn_id", "mode").dropDuplicates(["turn_id"])
    return of.join(find_defects(turns), "turn_id", "left").groupBy("mode", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("turns"))
