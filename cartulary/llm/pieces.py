"""Cutting oversized Markdown texts into pieces at natural boundaries, by packing a structure tree.

A text is a tree of sections (by heading level), blocks (by blank lines, code fences whole), list items, lines,
sentences and words. Sibling subtrees are merged from the bottom up while they fit; only nodes that are too large are
parsed further down. What is left without white space and is longer than a piece is cut by force.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize, small_or_not

#: What separates words.
BLANKS = " \t\r\n"

_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"[ ]{0,3}(```+|~~~+)")
_HEADING = re.compile(r"[ ]{0,3}(#{1,6})(?=[ \t\r\n]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]")
_SENTENCE = re.compile(r"[.!?…。！？][\"')\]»”’]*[ \t\r\n]+")
_SPACE = re.compile(r"[ \t\r\n]+")
_STOP = re.compile("[。！？，、.,;:!?]")


class Tree:
    """The structure of one text; positions count characters from 0."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit = text, limit
        self.lines: list[int] = []
        self.headings: list[tuple[int, int]] = []
        self.blocks: list[int] = []
        self.items: list[int] = []
        self._scan()

    def _scan(self) -> None:
        """Where lines, headings with their levels, blocks and list items begin; nothing inside a fence counts."""
        text, at, fence, blank = self.text, 0, "", False
        while at < len(text):
            m = _LINE.search(text, at)
            end = m.end() if m else len(text)
            self.lines.append(at)
            if fence:
                f = _FENCE.match(text, at)
                if f and f[1][0] == fence[0] and len(f[1]) >= len(fence):
                    fence = ""
            else:
                empty = not text[at:end].strip(BLANKS)
                if blank and not empty:
                    self.blocks.append(at)
                blank = empty
                if h := _HEADING.match(text, at, end):
                    self.headings.append((at, len(h[1])))
                elif _ITEM.match(text, at, end):
                    self.items.append(at)
                elif f := _FENCE.match(text, at, end):
                    fence = f[1]
            at = end
        self._heads, self._block_set = {p for p, _ in self.headings}, set(self.blocks)

    def pieces(self) -> list[tuple[int, int]]:
        """Ranges that cover the text in order."""
        return self._section(0, len(self.text), self.headings)

    def _pack(self, cuts: list[int], start: int, end: int, down) -> list[tuple[int, int]]:
        """Merges the parts between ``cuts``; parts that are too large are packed by ``down`` first."""
        out: list[tuple[int, int]] = []
        edges = [start, *(c for c in cuts if start < c < end), end]
        for a, b in zip(edges, edges[1:], strict=False):
            for x, y in [(a, b)] if b - a <= self.limit else down(a, b):
                if out and y - out[-1][0] <= self.limit:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
        return out

    def _section(self, start: int, end: int, headings: list[tuple[int, int]]) -> list[tuple[int, int]]:
        inner = [(p, level) for p, level in headings if start < p < end]
        if end - start <= self.limit:
            return [(start, end)]
        if not inner:
            return self._level(start, end, 0)
        top = min(level for _, level in inner)
        return self._pack([p for p, level in inner if level == top], start, end, lambda a, b: self._section(a, b, [h for h in inner if h[1] > top]))

    def _level(self, start: int, end: int, k: int) -> list[tuple[int, int]]:
        if k == 5:
            return self._words(start, end)
        if k < 3:
            cuts = _within((self.blocks, self.items, self.lines)[k], start, end)
        else:
            pattern = (_SENTENCE, _SPACE)[k - 3]
            cuts = [m.end() for m in pattern.finditer(self.text, start, end)]
        return self._pack(cuts, start, end, lambda a, b: self._level(a, b, k + 1))

    def _words(self, start: int, end: int) -> list[tuple[int, int]]:
        """One word with the blanks after it, too large together: the blanks may be cut anywhere."""
        m = _SPACE.search(self.text, start, end)
        stop = m.start() if m else end
        out = self._force(start, stop) if stop > start else []
        while stop < end:
            room = self.limit - (stop - out[-1][0]) if out else 0
            if room > 0:
                out[-1] = (out[-1][0], min(end, stop + room))
                stop = out[-1][1]
            else:
                out.append((stop, min(end, stop + self.limit)))
                stop = out[-1][1]
        return out

    most = 0  # characters that a piece may have at most; set by ``cut``

    def _force(self, start: int, end: int) -> list[tuple[int, int]]:
        """A word longer than a piece: cut behind punctuation in the last tenth, never before a combining mark."""
        if end - start <= max(self.most, self.limit):
            return [(start, end)]
        out = []
        while end - start > self.limit:
            at = start + self.limit
            stops = [m.end() for m in _STOP.finditer(self.text, at - self.limit // 10, at)]
            at = stops[-1] if stops else at
            for back in range(at, max(start, at - 32), -1):
                c = self.text[back]
                if not (0x300 <= ord(c) <= 0x36F or c in "‍️" or self.text[back - 1] == "‍"):
                    at = back
                    break
            out.append((start, at))
            start = at
        return [*out, (start, end)]

    def kind(self, at: int) -> str:
        """What stands at a cut."""
        if at >= len(self.text):
            return "end"
        if at in self._heads:
            return "heading"
        if at in self._block_set:
            return "blank line"
        before, after = self.text[at - 1], self.text[at]
        if before in "\r\n":
            return "line"
        if before not in BLANKS and after not in BLANKS:
            return "forced"
        return "sentence" if re.search(r"[.!?…。！？][\"')\]»”’]*[ \t]*$", self.text[max(0, at - 16) : at]) else "word"


def _within(sorted_: list[int], start: int, end: int) -> list[int]:
    from bisect import bisect_left, bisect_right

    return sorted_[bisect_right(sorted_, start) : bisect_left(sorted_, end)]


def cut(text: str, most: int = 4000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """Pieces (start, begin, end, boundary) of at most ``most`` characters.

    The parts [begin, end) cover the text one after another; [start, begin) repeats up to ``overlap`` last characters of
    the piece before, from a word's beginning if there is one within a fifth of them. ``boundary`` is what stands at the
    end: heading, blank line, line, sentence, word, forced or end.
    """
    tree = Tree(text, most - overlap)
    tree.most = most
    out: list[tuple[int, int, int, str]] = []
    for begin, end in tree.pieces() if len(text) > most else [(0, len(text))]:
        start = begin
        if out:
            start = max(out[-1][0], begin - min(overlap, most - (end - begin)))
            m = _SPACE.search(text, max(0, start - 1), min(begin, start + overlap // 5))
            if m and m.end() < begin:
                start = m.end()
        out.append((start, begin, end, tree.kind(end)))
    return out


def pieces(df: DataFrame, key_col: str = "path", text_col: str = "body", most: int = 4000, overlap: int = 200, texts: bool = True) -> DataFrame:
    """Pieces of the texts of more than ``most`` characters: (key_col, piece_no, start, begin, end, boundary, text).

    Positions count characters from 0; see ``cut``. Shorter and null texts give no rows, so only oversized texts reach
    Python. Repeated rows count once; rows with a null key are kept as a key of their own. ``texts`` False leaves the
    text of the pieces out.
    """
    big = (
        df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
        .filter(F.length("text") > most)
    )
    schema = f"key {df.schema[key_col].dataType.simpleString()}, piece_no int, start int, begin int, `end` int, boundary string" + (", text string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                which, rows, body = [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    for no, p in enumerate(cut(t, most, overlap)):
                        which.append(k), rows.append((no, *p))
                        if texts:
                            body.append(t[p[0] : p[2]])
                columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
                arrays = [part.column(0).take(pa.array(which, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(columns, (*[pa.int32()] * 4, pa.string()), strict=True)]
                names = ["key", "piece_no", "start", "begin", "end", "boundary"]
                if texts:
                    arrays, names = [*arrays, pa.array(body, pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    if texts:
        return _once(big).mapInArrow(run, schema).withColumnRenamed("key", key_col)
    return big.mapInArrow(run, schema).distinct().withColumnRenamed("key", key_col)


def _once(big: DataFrame) -> DataFrame:
    """(key, text) without repeated rows: only digests of all texts, and the texts that are repeated, are exchanged."""
    keyed = big.withColumn("m", F.md5("text"))
    again = materialize(keyed.groupBy("key", "m").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), F.col("m").alias("d")))
    if again.isEmpty():
        return big
    same, again = F.col("key").eqNullSafe(F.col("k")) & (F.col("m") == F.col("d")), small_or_not(again)
    rest, more = keyed.join(again, same, "left_anti"), keyed.join(again, same, "left_semi").dropDuplicates(["key", "m"])
    return rest.unionByName(more).drop("m")
