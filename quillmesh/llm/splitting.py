"""Splitting oversized segments at natural boundaries.

Every code point position gets the strength of the boundary before it. A sparse table of
range maxima (value = strength, then position, so that ties go right) answers each
window query in constant time: the next cut is the strongest boundary among the
permissible piece lengths, then the start steps back by the overlap.

The JVM side filters the oversized rows by code point count before any text reaches
Python; there is no shuffle, and the eight limits travel as a broadcast.

The column headers of a sheet stand before every piece but the first. Headers that leave a
piece no room beside them are cut themselves by the same rule: pieces of headers alone
come first (`start` = `end` = 0), so none of their text is lost.

No piece starts or ends inside a character of several code points, unless one such
character is longer than the limit; an overlap that would start there starts earlier.

Defined results: null, empty and fitting texts give no piece. A limit that is null or
below 1 never splits. An overlap not below the room of a piece is lowered to room - 1, a
negative one counts as 0. Repeated rows are split each on its own. Columns of the input
other than the ones used here are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of a boundary, strongest first (fixed values of this operator).
PAGE, PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, CHARACTER, INSIDE = 8, 7, 6, 5, 4, 3, 1, 0
#: Code points that belong to the one before: combining marks, joiners, selectors, skin tones.
_CLINGING = ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x93C, 0x94D), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200D, 0x200D), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x1F3FB, 0x1F3FF))
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？．"], np.uint32)
_PAUSES = np.array([ord(c) for c in ",;:–—"], np.uint32)
_WIDE_PAUSES = np.array([ord(c) for c in "、，；："], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’"], np.uint32)
#: Share of its room that a piece has at least; below it a stronger boundary does not make up for a short piece.
LEAST_SHARE = 0.5
#: Positions that one range-maximum table covers; longer texts get one table after another.
TABLE_SPAN = 1 << 16

PIECES = "seg_id long, file string, seg_no int, page int, sheet string, slide int, piece_no int, n_pieces int, start int, end int, piece string"


def strengths(points: np.ndarray, quoted_cells: bool = False) -> np.ndarray:
    """Strength of the cut before each code point (index 0 is no cut)."""
    n = len(points)
    out = np.full(n, CHARACTER, np.int64)
    if n < 2:
        return out
    before, at = points[:-1], points[1:]
    blank_before = np.isin(before, _BLANKS)
    s = out[1:]
    s[blank_before & ~np.isin(at, _BLANKS)] = BLANK
    if quoted_cells:
        s[before == ord(",")] = CLAUSE
    # a stop or pause before the blanks; closers between the stop and the blank are stepped over
    last = np.where(np.isin(points, _BLANKS), -1, np.arange(n))
    ends = np.maximum.accumulate(last)[:-1]  # last code point that is no blank
    mark = np.where(ends >= 0, points[np.maximum(ends, 0)], 0)
    mark = np.where(np.isin(mark, _CLOSERS) & (ends > 0), points[np.maximum(ends - 1, 0)], mark)
    word_starts = s == BLANK
    s[word_starts & np.isin(mark, _PAUSES)] = CLAUSE
    s[word_starts & np.isin(mark, _STOPS)] = SENTENCE
    s[np.isin(before, _WIDE_PAUSES)] = CLAUSE
    s[np.isin(before, _WIDE_STOPS)] = SENTENCE
    line_end = (before == 10) | ((before == 13) & (at != 10)) | (before == 0x2028) | (before == 0x2029)
    s[line_end] = LINE
    # an empty line: only CR and LF since the line end before this one
    newline = points == 10
    empty = np.zeros(n, bool)
    if newline.any():
        where = np.flatnonzero(newline)
        gap = np.diff(where, prepend=-10)
        twice = (gap == 1) | ((gap == 2) & (points[np.maximum(where - 1, 0)] == 13))
        empty[where[twice]] = True
    s[empty[:-1]] = PARAGRAPH
    s[before == 12] = PAGE
    if quoted_cells:
        inside = (np.cumsum(points == ord('"'))[:-1] % 2) == 1
        s[inside & (s > CHARACTER)] = CHARACTER
    cling = np.zeros(n - 1, bool)
    for low, high in _CLINGING:
        cling |= (at >= low) & (at <= high)
    cling |= (before == 0x200D) | ((before == 13) & (at == 10))
    s[cling] = INSIDE
    return out


class RangeMaximum:
    """Sparse table over `values`: `argmax(a, b)` is the rightmost place of the maximum in a..b, both included."""

    def __init__(self, values: np.ndarray, longest: int):
        n = len(values)
        self.n = n
        keyed = values * n + np.arange(n)
        self.levels = [keyed]
        width = 1
        while 2 * width <= min(longest, n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: n - 2 * width + 1], last[width : n - width + 1]))
            width *= 2

    def argmax(self, a: int, b: int) -> int:
        k = (b - a + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[a], level[b - (1 << k) + 1])) % self.n


def cut_points(text: str, limit: int, overlap: int, header: int = 0, quoted_cells: bool = False, least_share: float = LEAST_SHARE) -> list[tuple[int, int]]:
    """Start and end of each piece of `text`; pieces after the first leave room for `header` code points.

    A piece has at least `least_share` of its room, and always more than the overlap.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    value = strengths(points, quoted_cells)
    pieces, start, base, index, reached = [], 0, -1, None, 0
    while True:
        room = limit if start == 0 else max(1, limit - header)
        if n - start <= room:
            pieces.append((start, n))
            return pieces
        back = min(max(0, overlap), max(1, limit - header) - 1)
        low, high = max(start + min(room, max(back + 1, int(np.ceil(room * least_share)))), reached + 1), start + room
        if index is None or low < base or high >= base + index.n:
            base = low
            index = RangeMaximum(value[base : base + TABLE_SPAN + room], limit)
        end = base + index.argmax(low - base, high - base)
        pieces.append((start, end))
        after = end - back
        while after > start and value[after] == INSIDE:  # the overlap starts with a whole character
            after -= 1
        onward = after + max(1, limit - header) > end
        start, reached = after if onward else end - back, end


def split_segments(segments: DataFrame, limits: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """Pieces of every segment whose text has more code points than its format allows.

    The piece text of a sheet starts with the column headers (and a line end) if it does
    not already; together they stay within the limit. `start` and `end` count code points of the segment's text.
    """
    known = limits.select(F.col("format").alias("_format"), F.col("max_chars").alias("_limit"), F.col("overlap_chars").alias("_overlap"))
    other = known.where("_format = 'other'").select(F.struct("_limit", "_overlap").alias("_else")).limit(1)
    fmt = F.regexp_extract(F.lower(F.col("file")), r"\.([^./]+)$", 1)
    rows = segments.select("seg_id", "file", "seg_no", "page", "sheet", "slide", "text", "column_headers", F.coalesce(fmt, F.lit("")).alias("_format"))
    sized = (
        rows.join(F.broadcast(known), "_format", "left")
        .join(F.broadcast(other), F.lit(True), "left")
        .withColumn("_overlap", F.when(F.col("_limit").isNull(), F.col("_else._overlap")).otherwise(F.col("_overlap")))
        .withColumn("_limit", F.coalesce("_limit", "_else._limit"))
        .where((F.col("_limit") >= 1) & (F.char_length("text") > F.col("_limit")))
        .select("seg_id", "file", "seg_no", "page", "sheet", "slide", "text", "column_headers", "_format", "_limit", "_overlap")
    )
    return sized.mapInPandas(lambda batches: _split_batches(batches, least_share), PIECES)


def pieces_of(text: str, limit: int, overlap: int, headers: str | None, sheet: bool, least_share: float = LEAST_SHARE) -> list[tuple[int, int, str]]:
    """(start, end, piece) of one text that is over its limit."""
    header = headers if sheet and headers else ""
    alone = []
    if header and len(header) + 1 >= limit:  # no room for text beside them
        alone = [(0, 0, header[a:b]) for a, b in cut_points(header, limit, overlap, 0, sheet, least_share)] if not text.startswith(header) else []
        header = ""
    out = []
    for i, (a, b) in enumerate(cut_points(text, limit, overlap, len(header) + 1 if header else 0, sheet, least_share)):
        piece = text[a:b]
        out.append((a, b, header + "\n" + piece if header and i and not piece.startswith(header) else piece))
    return alone + out


def _split_batches(batches: Iterator[pd.DataFrame], least_share: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            limit, overlap = int(r[9]), 0 if pd.isna(r[10]) else int(r[10])
            sheet = r[4] is not None or r[8] in ("xlsx", "xls", "csv", "tsv")
            cuts = pieces_of(r[6], limit, overlap, r[7] if isinstance(r[7], str) else None, sheet, least_share)
            out += [(*r[:6], i, len(cuts), *c) for i, c in enumerate(cuts, 1)]
        frame = pd.DataFrame(out, columns=["seg_id", "file", "seg_no", "page", "sheet", "slide", "piece_no", "n_pieces", "start", "end", "piece"])
        for c in ("seg_no", "page", "slide"):
            frame[c] = frame[c].astype("Int32")
        yield frame


def oversized(pieces: DataFrame) -> DataFrame:
    """The segments that had to be split."""
    return pieces.where("piece_no = 1").select("seg_id")
