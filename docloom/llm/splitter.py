"""Cutting oversized texts at natural boundaries.

A text is read as a tree: sections nested by the level of their headings, paragraphs between blank lines, blocks (a
heading line, or a list item with its lines), lines, sentences, words, and below a word its ideographic sentences and
characters. Packing goes bottom-up: a node that fits stays whole, neighbouring siblings are merged while they fit
together, and only an oversized node is replaced by its children. Siblings are merged within their parent only, and a
heading stays with what follows it. Pieces are spans of the text, so the text can be put together again.

How natural a cut could be is read off the tree: the deepest kind of node that had to be opened at the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BLANKS

HEADING = re.compile(r"[ \t]*(#{1,6})[ \t]+\S")
ITEM = re.compile(r"[ \t]*(?:[-*+•–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+\S")
PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+")
LINE = re.compile(r"\r\n|\n|\r")
SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]』」）]*[ \t]+|(?<=[;:])[ \t]+")
WORD = re.compile(r"[ \t]+")
WIDE = re.compile(r"[。！？…]+[”’」』）]*")
LEVELS = ("paragraph", "line", "word", "unbroken")
#: Kinds of nodes from the root down, and the level that opening a node of the kind leads to.
SECTION, PART, BLOCK, ROW, SAID, RUN, WRITTEN = range(7)
_LEVEL = {SECTION: 0, PART: 1, BLOCK: 1, ROW: 2, SAID: 2, RUN: 3, WRITTEN: 3}


@dataclass
class Node:
    """A span of the text; ``a`` and ``b`` leave its outer blanks out. ``heads`` marks a heading."""

    start: int
    end: int
    kind: int
    a: int
    b: int
    heads: bool = False
    children: list[Node] | None = field(default=None, repr=False)


class Tree:
    """The structure tree of one text; children are made when a node is opened."""

    def __init__(self, text: str):
        self.text = text
        a, b = self.extent(0, len(text))
        self.root = Node(a, b, SECTION, a, b)

    def extent(self, start: int, end: int) -> tuple[int, int]:
        """start..end without outer blanks."""
        while start < end and self.text[start] in BLANKS:
            start += 1
        while end > start and self.text[end - 1] in BLANKS:
            end -= 1
        return start, end

    def node(self, start: int, end: int, kind: int) -> Node:
        n = Node(start, end, kind, *self.extent(start, end))
        n.heads = kind in (PART, BLOCK, ROW) and HEADING.match(self.text, n.a, n.b) is not None and not LINE.search(self.text, n.a, n.b)
        return n

    def cut(self, n: Node, ends: list[int], kind: int) -> list[Node]:
        edges = [n.start, *ends, n.end]
        return [c for s, e in zip(edges, edges[1:]) if (c := self.node(s, e, kind)).b > c.a]

    def ends(self, pattern: re.Pattern, n: Node) -> list[int]:
        return [m.end() for m in pattern.finditer(self.text, n.start, n.end) if n.start < m.end() < n.end]

    def open(self, n: Node) -> list[Node]:
        """The children of a node, in order; none for a span that has no parts."""
        if n.children is None:
            n.children = self._open(n)
        return n.children

    def _open(self, n: Node) -> list[Node]:
        if n.kind == SECTION:
            return self.sections(self.cut(n, self.ends(PARAGRAPH, n), PART))
        if n.kind == PART:
            starts = [n.start, *self.ends(LINE, n)]
            marks = [s for s in starts[1:] if HEADING.match(self.text, s, n.end) or ITEM.match(self.text, s, n.end)]
            for s, e in zip(starts, [*starts[1:], n.end]):  # a heading is a block by itself
                if e < n.end and e not in marks and HEADING.match(self.text, s, e):
                    marks.append(e)
            return self.sections(self.cut(n, sorted(marks), BLOCK)) if marks else self.cut(n, starts[1:], ROW)
        if n.kind == BLOCK:
            return self.cut(n, self.ends(LINE, n), ROW)
        if n.kind == ROW:
            return self.cut(n, self.ends(SENTENCE, n), SAID)
        if n.kind == SAID:
            return self.cut(n, self.ends(WORD, n), RUN)
        if n.kind == RUN:
            return self.cut(n, self.ends(WIDE, n), WRITTEN)
        return []

    def sections(self, parts: list[Node]) -> list[Node]:
        """Parts nested under their headings: a section holds its heading and all up to the next of its level."""
        top: list[Node] = []
        open_: list[tuple[int, Node]] = []
        for p in parts:
            m = HEADING.match(self.text, p.a, p.b)
            if m:
                level = len(m[1])
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                s = Node(p.start, p.end, SECTION, p.a, p.b, children=[p])
                (open_[-1][1].children if open_ else top).append(s)
                open_.append((level, s))
            else:
                (open_[-1][1].children if open_ else top).append(p)
            for _, s in open_:
                s.end, s.b = max(s.end, p.end), max(s.b, p.b)
        return top

    def level(self, limit: int) -> str | None:
        """The level of the deepest node that has to be opened so that all fit; None if the whole text does."""
        deepest, todo = -1, [self.root]
        while todo:
            n = todo.pop()
            if n.b - n.a > limit:
                deepest = max(deepest, _LEVEL[n.kind])
                todo += self.open(n)
        return None if deepest < 0 else LEVELS[deepest]

    def pack(self, n: Node, most: int, lead: int | None = None) -> list[tuple[int, int]]:
        """Spans of at most ``most`` that cover the node; the first begins at ``lead``, where a heading waits, if given."""
        a = n.a if lead is None else lead
        if n.b - a <= most:
            return [(a, n.b)] if n.b > a else []
        kids = self.open(n)
        if not kids or len(kids) == 1 and kids[0].kind == WRITTEN:
            return [(i, min(i + most, n.b)) for i in range(a, n.b, most)]
        out: list[tuple[int, int]] = []
        held, heading = lead, lead is not None  # where the piece under way begins; whether it holds headings only
        last = n.a
        for c in kids:
            if held is not None and c.b - held <= most:
                heading = heading and c.heads
            elif held is None and c.b - c.a <= most:
                held, heading = c.a, c.heads
            else:
                if held is not None and not heading:
                    out.append((held, last))
                    held = None
                if held is None and c.b - c.a <= most:
                    held, heading = c.a, c.heads
                else:  # oversized, alone or together with the heading before it
                    out += self.pack(c, most, held)
                    held = None
            last = c.b
        if held is not None:
            out.append((held, last))
        return out


def pieces(text: str, limit: int = 900, overlap: int = 120, tree: Tree | None = None) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters without outer blanks that together cover all non-blank text.

    A piece after the first starts ``overlap`` characters before the last one's end, or at the first word start within
    them; what it adds is at most ``limit - overlap`` long. A text that fits is one piece; a blank one has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    tree = tree or Tree(text)
    a, b = tree.root.a, tree.root.b
    if b - a <= limit:
        return [(a, b)] if b > a else []
    spans = [(s, e) for s, e in (tree.extent(s, e) for s, e in tree.pack(tree.root, limit - overlap)) if e > s]
    out = [spans[0]]
    for (_, last), (s, e) in zip(spans, spans[1:]):
        at = max(last - overlap, out[-1][0] + 1, e - limit)
        while at < last and text[at - 1] not in BLANKS:
            at += 1
        if at >= last:
            at = max(last - overlap, out[-1][0] + 1, e - limit)
        out.append((tree.extent(at, e)[0], e))
    return out


SCHEMA = pa.schema([
    ("document_id", pa.string()), ("chunk_index", pa.int32()), ("total_chunks", pa.int32()), ("start", pa.int32()),
    ("text", pa.string()), ("cut_level", pa.string()),
])


def split(documents: DataFrame, limit: int = 900, overlap: int = 120, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of ``documents(document_id, text)``: ``document_id, chunk_index, total_chunks, start, text, cut_level``.

    ``start`` is 0-based in the text; ``cut_level`` (of ``Tree.level``) is null for a text that fits. A document id
    counts once (rows repeat it with the same text); null and blank texts give no rows; a null id is kept as null.
    """
    docs = documents.select("document_id", "text").where("text is not null")
    if oversized_only:
        docs = docs.where(F.length(F.btrim("text", F.lit(BLANKS))) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = Tree(text)
                spans = pieces(text, limit, overlap, tree)
                level = tree.level(limit)
                rows += [(key, i, len(spans), s, text[s:e] if with_text else None, level) for i, (s, e) in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, SCHEMA.types)], schema=SCHEMA)

    return docs.mapInArrow(run, "document_id string, chunk_index int, total_chunks int, start int, text string, cut_level string").dropDuplicates(
        ["document_id", "chunk_index"]
    )


def found(documents: DataFrame) -> DataFrame:
    """``document_id, cut_level`` of the segments that had to be cut."""
    return split(documents, oversized_only=True, with_text=False).where("chunk_index = 0").select("document_id", "cut_level")
