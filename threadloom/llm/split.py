"""Cutting oversized texts at their natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections by the ranks of their headings, in them fenced code blocks and paragraphs, in these list
items (with the items below them), tables and lines, then sentences, words and at last single characters. From the bottom up,
neighbouring children of one node are merged as long as they stay under the limit less the overlap; a node up to the limit is a piece of
its own; only larger ones are descended into, and their pieces are not merged with anything outside of them. So a piece
runs across a heading only if it holds whole sections. Every further piece starts up to ``overlap`` characters before the end of the
one before it, at the nearest boundary inside that stretch where there is one, and no more than the limit leaves room for.

The boundary of a text is the finest kind of cut among the nodes descended into. A paragraph that a heading or a fence
begins inside of counts whole.

All pieces are exact substrings, each at most ``limit`` characters long; without the overlaps they give the text back. A
null or empty text gives no piece; a text within the limit is one piece; white space is kept where it stands. White space
is space, tab, CR and LF, and does not count for the size of a node that is to be descended into. Characters are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "line", "sentence", "word")
_LINE_END = re.compile(r"\r\n|\r|\n")
_BLANK = re.compile(r"(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+|\A(?:[ \t]*(?>\r\n|\r|\n))+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+|\r\n|\r|\n")
_WORD = re.compile(r"[ \t\r\n]+")
_CUTS = {"paragraph": _BLANK, "line": _LINE_END, "sentence": _SENTENCE, "word": _WORD}
_HEADING = re.compile(r"(#{1,6})[ \t]+\S|<h([1-6])[ >]", re.I)
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]|([ \t]*)<li[ >]", re.I)
_ROW = re.compile(r"[ \t]*\||[ \t]*<tr[ >]", re.I)
_SPACE = " \t\r\n"
#: List items nested deeper than this are taken as lines.
DEEP = 32
#: Number of the level at whose boundaries the children of a node lie.
_CUT = {"section": 0, "fence": 0, "paragraph": 1, "item": 1, "table": 1, "line": 2, "sentence": 3, "word": 4}


def cuts(text: str, level: str, start: int = 0, end: int | None = None) -> list[int]:
    """Positions after which a new segment of the level starts, inside (start, end)."""
    end = len(text) if end is None else end
    return [m.end() for m in _CUTS[level].finditer(text, start, end) if start < m.end() < end]


@dataclass
class Node:
    """A stretch of the text. Sections know their children from the parse; what is below a paragraph is parsed when it is needed."""

    kind: str
    start: int
    end: int
    rank: int = 0
    children: list[Node] = field(default_factory=list)


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    edges = [start, *cuts(text, "line", start, end), end]
    return list(zip(edges, edges[1:]))


def _fenced(text: str, lines: list[tuple[int, int]]) -> dict[int, int]:
    """First and last line of each fence that is closed."""
    found, opened = {}, None
    for i, (s, e) in enumerate(lines):
        m = _FENCE.match(text, s, e)
        if m and opened is None:
            opened = (i, m[1])
        elif m and m[1] == opened[1]:
            found[opened[0]] = i
            opened = None
    return found


def _size(text: str, start: int, end: int) -> int:
    return len(text[start:end].strip(_SPACE))


def parse(text: str) -> tuple[Node, int]:
    """The tree of sections, fences and paragraphs, and the size of the largest paragraph without regard to headings and fences."""
    root = Node("section", 0, len(text))
    lines = _lines(text, 0, len(text))
    fences = _fenced(text, lines)
    open_, stack = None, [root]  # the block that the next line may belong to, and the open sections
    until, widest, run = -1, 0, None  # last line of the open fence; the open run of lines that aren't blank

    def begin(kind: str, at: int) -> Node:
        first = 0 if stack == [root] and not root.children else at  # blank lines before it
        stack[-1].children.append(Node(kind, first, at))
        return stack[-1].children[-1]

    block = None
    for i, (s, e) in enumerate(lines):
        blank = not text[s:e].strip(_SPACE)
        if blank and run is not None:
            widest, run = max(widest, _size(text, *run)), None
        elif not blank:
            run = (s if run is None else run[0], e)
        heading = None if blank or i <= until else _HEADING.match(text, s, e)
        if i in fences and i > until:
            until, open_ = fences[i], None
            block = begin("fence", s)
        elif i <= until:
            pass
        elif blank:
            open_ = None
        elif heading:
            rank = len(heading[1]) if heading[1] else int(heading[2])
            while stack[-1].rank >= rank:
                stack.pop()
            first = 0 if not root.children else s
            stack[-1].children.append(Node("section", first, s, rank))
            stack.append(stack[-1].children[-1])
            block, open_ = begin("paragraph", first), None
        elif open_ is None:
            block = open_ = begin("paragraph", s)
        if block is not None:
            block.end = e
            for node in stack:
                node.end = e
        if i == until:
            open_ = None
    if run is not None:
        widest = max(widest, _size(text, *run))
    if not root.children:
        root.children.append(Node("paragraph", 0, len(text)))
    return root, widest


def _grouped(text: str, start: int, end: int, depth: int) -> list[Node]:
    """List items of the least indent with all that is below them, tables, and the other lines of a stretch."""
    lines = _lines(text, start, end)
    marks = [_ITEM.match(text, s, e) if depth < DEEP else None for s, e in lines]
    indent = [len((m[1] or m[2] or "").expandtabs(4)) if m else None for m in marks]
    least = min((n for n in indent if n is not None), default=None)
    out: list[Node] = []
    for (s, e), n in zip(lines, indent):
        row = n is None and _ROW.match(text, s, e) is not None
        if n is not None and n == least:
            out.append(Node("item", s, e, depth))
        elif out and out[-1].kind == "item" or row and out and out[-1].kind == "table":
            out[-1].end = e
        else:
            out.append(Node("table" if row else "line", s, e))
    return out


def _children(text: str, node: Node) -> list[Node]:
    if node.children:
        return node.children
    s, e = node.start, node.end
    if node.kind == "item":
        first = next(iter(cuts(text, "line", s, e)), e)
        return [Node("line", s, first), *(_grouped(text, first, e, node.rank + 1) if first < e else [])]
    if node.kind == "paragraph":
        return _grouped(text, s, e, 0)
    of, level = {"fence": ("paragraph", "paragraph"), "table": ("line", "line"), "line": ("sentence", "sentence"), "sentence": ("word", "word")}[node.kind]
    edges = [s, *cuts(text, level, s, e), e]
    return [Node(of, a, b) for a, b in zip(edges, edges[1:])]


def _stretches(start: int, end: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, end)) for a in range(start, end, step)]


def _alone(text: str, node: Node, target: int, limit: int) -> list[tuple[int, int]]:
    """A node that fits but for the white space around it."""
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    part = text[node.start : node.end]
    first = node.start + len(part) - len(part.lstrip(_SPACE))
    last = min(node.end, first + limit)
    return [*_stretches(node.start, first, target), *([(first, last)] if last > first else []), *_stretches(last, node.end, target)]


def packed(text: str, limit: int, target: int) -> tuple[list[tuple[int, int]], int]:
    """The pieces of a text above the limit, side by side, and the number of its boundary's level.

    ``target`` is the size that merged siblings stay under. The descent keeps its own stack, as lists may be nested deeply.
    """
    root, widest = parse(text)
    level = 1 if widest > limit else 0
    stack: list[tuple[Node, Iterator[Node], list]] = []
    done: list[tuple[int, int]] | None = None  # pieces of the node just finished
    node: Node | None = root

    while True:
        if node is not None:
            if node.end - node.start <= target:
                done = [(node.start, node.end)]
            elif node.end - node.start <= limit or _size(text, node.start, node.end) <= limit:
                done = _alone(text, node, target, limit)
            else:
                level = max(level, _CUT[node.kind])
                if node.kind == "word":
                    done = _stretches(node.start, node.end, target)
                else:
                    stack.append((node, iter(_children(text, node)), []))
                    done = None
        if done is not None:
            if not stack:
                return done, level
            parts, whole = stack[-1][2], node is not None and len(done) == 1
            if whole and parts and parts[-1][2] and done[0][1] - parts[-1][0] <= target:
                parts[-1] = (parts[-1][0], done[0][1], True)
            else:
                parts += [(a, b, whole) for a, b in done]
            done = None
        node = next(stack[-1][1], None)
        if node is None:
            done = [(a, b) for a, b, _ in stack.pop()[2]]


def boundary(text: str, limit: int) -> str:
    """The finest level at which nodes above ``limit`` had to be cut: the first at which cutting everywhere leaves no segment above it."""
    level = packed(text, limit, limit)[1]
    return LEVELS[level] if level < len(LEVELS) else "none"


def cut_text(text: str | None, limit: int, overlap: int) -> tuple[list[tuple[int, int]], str | None]:
    """((start, end) of the pieces of a text, the boundary at which it was cut); no boundary for a text within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return [], None
    if len(text) <= limit:
        return [(0, len(text))], None
    found, level = packed(text, limit, limit - overlap)
    out: list[tuple[int, int]] = []
    for start, end in found:
        first, room = start, min(overlap, limit - (end - start))
        if out and room:
            first = lo = max(start - room, out[-1][0] + 1)
            for name in LEVELS:
                near = [c for c in cuts(text, name, lo, start) if text[c:start].strip(_SPACE)]
                if near:
                    first = near[0]
                    break
        out.append((first, end))
    return out, LEVELS[level] if level < len(LEVELS) else "none"


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    return cut_text(text, limit, overlap)[0]


def split_texts(df: DataFrame, ident: str, text: str, limit: int, overlap: int) -> DataFrame:
    """``(ident, boundary, piece, start, end, content)`` of every text above ``limit`` characters.

    The size filter runs in the scan's stage, so only oversized texts reach Python; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                spans, cut_at = cut_text(body, limit, overlap)
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array([cut_at] * n, pa.string()), pa.array(range(n), pa.int32()),
                     pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32()), pa.array([body[s:e] for s, e in spans], pa.string())],
                    names=[ident, "boundary", "piece", "start", "end", "content"],
                )

    kind = df.schema[ident].dataType.simpleString()
    large = df.where(F.length(F.col(text)) > limit).select(ident, text)
    return large.mapInArrow(run, f"`{ident}` {kind}, boundary string, piece int, start int, end int, content string")
