"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is parsed into a tree: sections by heading level (prose), elements by nesting (markup)
or list items and lines by indentation, blocks between blank lines, sentences, words,
characters. A fenced block is one node until it has to be entered. Only nodes above
the limit are descended into; sibling subtrees are merged bottom-up as long as they fit:
a node that was descended into is finished, and what is left of it never joins a
sibling of its own. Pieces without their overlap tile the text exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s")
_UNDERLINE = re.compile(r"^([=\-~^\"'#*+])\1{2,}\s*$")
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][\w:.\-]*)(?:\s[^<>]*?)?(/?)>", re.S)
_SENTENCE = re.compile(r"(?<=[.!?;:。！？；])[\"')\]]*\s+|(?<=[。！？；])")
_STATEMENT = re.compile(r"(?<=[;{}>])")
_WORD_END = re.compile(r"(?<=\s)(?=\S)")
#: Languages with headings, languages of elements, and elements that are never closed.
PROSE = ("markdown", "rst", "text")
MARKUP = ("html", "xml")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

Span = tuple[int, int]


class Tree:
    """The boundaries of a text: ``marks``, starts of sections or elements by level, and ``fences``."""

    def __init__(self, text: str, language: str | None) -> None:
        self.text = text
        self.fences: list[Span] = []
        kind = (language or "text").lower()
        self.marks = self._headings() if kind in PROSE else self._elements() if kind in MARKUP else []

    def lines(self, a: int, b: int) -> list[Span]:
        out, at = [], a
        while at < b:
            nl = self.text.find("\n", at, b)
            end = b if nl < 0 else nl + 1
            out.append((at, end))
            at = end
        return out

    def _headings(self) -> list[tuple[int, int]]:
        marks, lines, fence, since = [], self.lines(0, len(self.text)), "", 0
        for i, (a, b) in enumerate(lines):
            line = self.text[a:b]
            if m := _FENCE.match(line):
                if not fence:
                    fence, since = m[1], a
                elif m[1].startswith(fence) and not line.strip().strip(fence[0]):
                    self.fences.append((since, b))
                    fence = ""
                continue
            if fence:
                continue
            if m := _HEADING.match(line):
                marks.append((len(m[1]), a))
            elif i + 1 < len(lines) and line.strip() and not _UNDERLINE.match(line):
                under = self.text[lines[i + 1][0] : lines[i + 1][1]]
                if (m := _UNDERLINE.match(under)) and len(under.strip()) >= len(line.strip()):
                    marks.append((1 + "=-~^\"'#*+".index(m[1]), a))
        return marks

    def _elements(self) -> list[tuple[int, int]]:
        """Starts of elements, level 1 for outermost; an end tag closes what is open inside its element."""
        marks, open_ = [], []
        for m in _TAG.finditer(self.text):
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name in open_:
                    while open_.pop() != name:
                        pass
                continue
            marks.append((min(len(open_) + 1, 40), m.start()))
            if not m[3] and name not in VOID:
                open_.append(name)
        return marks

    def cut(self, a: int, b: int, starts: list[int], whole_fences: bool = True) -> list[Span]:
        """Parts of [a, b) at the starts, none of them inside a fenced block that lies in it as one of several nodes."""
        inside = [f for f in self.fences if a <= f[0] and f[1] <= b and f != (a, b)] if whole_fences else []
        kept = [s for s in starts if a < s < b and not any(x < s < y for x, y in inside)]
        edges = [x for f in inside for x in f if a < x < b]
        cuts = sorted({a, *kept, *edges, b})
        return list(zip(cuts, cuts[1:]))

    def children(self, a: int, b: int, rank: int) -> tuple[list[Span], int]:
        """Parts of a node under the first kind of boundary from ``rank`` on that divides it."""
        if rank <= 40:  # sections or elements, outermost level first
            inner = [(v, s) for v, s in self.marks if a < s < b]
            for v in sorted({v for v, _ in inner if v >= rank}):
                parts = self.cut(a, b, [s for h, s in inner if h <= v])
                if len(parts) > 1:
                    return parts, v + 1
            rank = 41
        if rank == 41:  # blocks between blank lines
            lines = self.lines(a, b)
            blank = [not self.text[s:e].strip() for s, e in lines]
            parts = self.cut(a, b, [lines[i][0] for i in range(1, len(lines)) if blank[i - 1] and not blank[i]])
            if len(parts) > 1:
                return parts, 41
            rank = 42
        if 42 <= rank < 100:  # items by indentation, outermost first
            lines = self.lines(a, b)
            depth = [len(t) - len(t.lstrip(" \t")) if (t := self.text[s:e].rstrip("\r\n")).strip() else 99 for s, e in lines]
            for d in sorted(set(depth[1:])):
                if d < rank - 42 or d >= 57:
                    continue
                parts = self.cut(a, b, [lines[i][0] for i in range(1, len(lines)) if depth[i] <= d])
                if len(parts) > 1:
                    return parts, min(99, 43 + d)
            rank = 100
        for kind, pattern in ((100, _SENTENCE), (101, _STATEMENT), (102, _WORD_END)):
            if rank <= kind:
                parts = self.cut(a, b, [m.end() for m in pattern.finditer(self.text, a, b)], False)
                if len(parts) > 1:
                    return parts, kind + 1
        return [], 103


def pack(text: str, limit: int, language: str | None = None) -> list[Span]:
    """Spans of at most ``limit`` characters that tile the text."""
    tree = Tree(text, language)

    def spans(a: int, b: int, rank: int) -> list[Span]:
        if b - a <= limit:
            return [(a, b)]
        parts, below = tree.children(a, b, rank)
        if not parts:
            out, at = [], a
            while at < b:
                end = min(at + limit, b)
                if end < b and text[end - 1] == "\r" and text[end] == "\n" and end - 1 > at:
                    end -= 1
                out.append((at, end))
                at = end
            return out
        out: list[Span] = []
        open_ = False  # whether the last piece is made of whole siblings
        for x, y in parts:
            if y - x > limit:
                out += spans(x, y, below)
                open_ = False
            elif open_ and y - out[-1][0] <= limit:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
                open_ = True
        return out

    return spans(0, len(text), 1) if text else []


def split_text(text: str, limit: int = 800, overlap: int = 120, language: str | None = None) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of the pieces; ``[core_start, end)`` tile the text.

    A text within the limit is one piece. Otherwise pieces hold up to ``limit`` less
    ``overlap`` own characters and begin up to ``overlap`` characters earlier, at a
    line start if there is one in the last three quarters of that stretch, else at
    a word start.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    core = pack(text, max(1, limit - overlap), language)
    newlines = [m.end() for m in re.finditer("\n", text)]
    out = []
    for i, (a, b) in enumerate(core):
        start = a
        if i and overlap:
            low = max(a - overlap, core[i - 1][0])
            lo, hi = bisect_left(newlines, low), bisect_right(newlines, a - overlap // 4)
            if low == core[i - 1][0]:
                start = low
            elif lo < hi:
                start = newlines[lo]
            else:
                m = _WORD_END.search(text, max(low, 0), a)
                start = m.end() if m else low
        out.append((start, a, b))
    return out


def split_oversized(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", start_col: str | None = "start_line", language_col: str | None = "language", *, limit: int = 800, overlap: int = 120
) -> DataFrame:
    """Pieces of the rows whose text is longer than ``limit`` characters (code points).

    ``<id>, piece, n_pieces, start_char, core_start, end_char, start_line, end_line,
    text``. Null, empty and short texts give no rows; repeated rows of an id are
    split once; a null start line counts as 1, a null language as prose. ``language_col`` is read if the
    frame has it. Lines are 1-based and inclusive; a
    line break at a piece's end belongs to its last line.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    start = F.coalesce(F.col(start_col).cast("long"), F.lit(1)) if start_col else F.lit(1)
    language = F.col(language_col).cast("string") if language_col in df.columns else F.lit(None).cast("string")
    big = (
        df.where(F.length(text_col) > limit)
        .select(F.col(id_col).cast("string").alias("id"), start.cast("long").alias("line"), language.alias("language"), F.col(text_col).alias("text"))
        .dropDuplicates(["id", "line", "text"])
    )

    def cut(it):
        for batch in it:
            for rid, line, kind, text in zip(*(batch.column(c).to_pylist() for c in ("id", "line", "language", "text"))):
                pieces = split_text(text, limit, overlap, kind)
                ends = [m.end() for m in re.finditer("\n", text)]
                first = [line + bisect_right(ends, a) for a, _, _ in pieces]
                last = [line + bisect_left(ends, b) for _, _, b in pieces]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rid] * k, pa.string()),
                        pa.array(range(1, k + 1), pa.int32()),
                        pa.array([k] * k, pa.int32()),
                        *(pa.array([p[i] for p in pieces], pa.int32()) for i in range(3)),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array([text[a:b] for a, _, b in pieces], pa.string()),
                    ],
                    ["id", "piece", "n_pieces", "start_char", "core_start", "end_char", "start_line", "end_line", "text"],
                )

    out = big.mapInArrow(
        cut, "id string, piece int, n_pieces int, start_char int, core_start int, end_char int, start_line long, end_line long, text string"
    )
    return out.withColumnRenamed("id", id_col)
