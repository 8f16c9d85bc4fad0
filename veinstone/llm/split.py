"""Oversized texts to pieces under a limit, cut at the strongest natural boundary that the length window permits.

Every boundary of a text has a strength; a sparse table over the boundaries answers which is the strongest, rightmost first, in
any window. A piece ends at the strongest boundary in the upper half of its permitted length (else the lower half, else, with no
boundary at all, at the limit: a forced cut); the next piece begins at the first boundary at most `overlap` before that end,
later only where the boundary after the end could not be reached otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, and the marks that end a sentence or clause without it.
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
WIDE_STOPS, WIDE_COMMAS = "。！？", "；，"
STOPS, COMMAS = ".!?…", ",;:"
#: Strengths from weak to strong: before a wide mark, before white space, after it, after a clause, a sentence, a line, a paragraph.
BEFORE_MARK, BEFORE_SPACE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(1, 8)

#: Characters for which boundaries are held at a time; longer texts are worked through in stretches.
STRETCH = 1_000_000
SCHEMA = "key bigint, piece_no int, start bigint, end bigint, cut string, text string"
_ARROW = pa.schema([("key", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cut", pa.string()), ("text", pa.string())])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _among(points: np.ndarray, marks: str) -> np.ndarray:
    return np.isin(points, np.array([ord(m) for m in marks], np.uint32))


def boundaries(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, strengths): place i lies between characters i - 1 and i, 0 < i < len(points)."""
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    space, stop, comma = np.isin(points, SPACES), _among(points, WIDE_STOPS), _among(points, WIDE_COMMAS)
    line = points == 10
    strength = np.zeros(n + 1, np.int8)
    strength[:-1][stop | comma] = BEFORE_MARK
    strength[:-1][space] = BEFORE_SPACE
    after = np.where(space, SPACE, 0).astype(np.int8)
    # What stands before a run of white space decides its strength; the run carries it to its end.
    run = np.maximum.accumulate(np.where(~space, np.arange(n), -1))
    solid = points[np.maximum(run, 0)]
    known = space & (run >= 0)
    after[known & _among(solid, COMMAS + WIDE_COMMAS)] = CLAUSE
    after[known & _among(solid, STOPS + WIDE_STOPS)] = SENTENCE
    lines = np.concatenate([[0], np.cumsum(line)])
    breaks = np.where(space, lines[1:] - lines[np.maximum(run, -1) + 1], 0)
    after[breaks == 1] = LINE
    after[breaks > 1] = PARAGRAPH
    after[comma] = CLAUSE
    after[stop] = SENTENCE
    strength[1:] = np.maximum(strength[1:], after)
    places = np.nonzero(strength[1:n])[0] + 1
    return places, strength[places]


class Strongest:
    """Sparse table of range maxima over strengths; of equal ones the rightmost wins."""

    def __init__(self, places: np.ndarray, strengths: np.ndarray, window: int) -> None:
        self.places = places
        row = strengths.astype(np.int64) * (len(places) + 1) + np.arange(len(places))
        self.rows, width = [row], 1
        while 2 * width <= min(len(places), window + 1):
            row = np.maximum(row[: len(row) - width], row[width:])
            self.rows.append(row)
            width *= 2

    def between(self, low: int, high: int) -> int | None:
        """The strongest place in [low, high]."""
        i, j = int(np.searchsorted(self.places, low)), int(np.searchsorted(self.places, high, "right"))
        if i >= j:
            return None
        level = min((j - i).bit_length() - 1, len(self.rows) - 1)
        row, width = self.rows[level], 1 << level
        best = max(int(row[i]), int(row[j - width]))
        return int(self.places[best % (len(self.places) + 1)])

    def first(self, low: int, high: int) -> int | None:
        i = int(np.searchsorted(self.places, low))
        return int(self.places[i]) if i < len(self.places) and self.places[i] <= high else None


def _whole(text: str, at: int, least: int) -> int:
    """The forced cut moved left, by at most 32, so that no mark is parted from its letter."""
    for place in range(at, max(least, at - 32), -1):
        if not (unicodedata.combining(text[place]) or text[place] in "‍︎️" or text[place - 1] == "‍"):
            return place
    return at


def cuts(text: str, limit: int = 3000, overlap: int = 1000) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece; cut is how its end was found: boundary, forced, or end of the text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")
    n, start, before, out = len(text), 0, 0, []
    base, index = 0, None
    while n - start > limit:
        if index is None or (base + STRETCH < n and start + 2 * limit > base + STRETCH):
            base = max(0, start - 2)  # two characters before tell whether start itself follows white space
            places, strengths = boundaries(_points(text[base : base + STRETCH + 2 * limit]))
            index = Strongest(places + base, strengths, limit)
        top = start + limit
        end = index.between(max(before + 1, start + limit // 2), top) or index.between(max(before, start) + 1, top)
        cut = "boundary" if end else "forced"
        end = end or _whole(text, top, max(before, start) + 1)
        out.append((start, end, cut))
        target = end - overlap
        after = index.first(end + 1, n) or n
        if after - target > limit >= after - end:
            target = after - limit
        begin = index.first(max(target, start + 1), end - 1) if cut == "boundary" or overlap else None
        start, before = max(begin if begin is not None else target, start + 1), end
    out.append((start, n, "end"))
    return out


def _splitter(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                for number, (start, end, cut) in enumerate(cuts(text, limit, overlap)):
                    rows.append((key.as_py(), number, start, end, cut, text[start:end] if with_text else None))
                    held += (end - start) * with_text + 64
                    if held > 16_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def split_texts(texts: DataFrame, key: str, text: str, limit: int = 3000, overlap: int = 1000, with_text: bool = True) -> DataFrame:
    """(key, piece_no, start, end, cut, text): the pieces of every text, in one narrow pass.

    Lengths and places count code points, white space too. Null texts give no piece; empty texts one empty piece; a text within
    the limit is one piece; other columns are not read.
    """
    rows = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text is not null")
    out = rows.mapInArrow(_splitter(limit, overlap, with_text), SCHEMA)
    return (out if with_text else out.drop("text")).withColumnRenamed("key", key)
