"""Splitting texts into overlapping chunks: fixed windows in Catalyst, the recursive separator splitter in an Arrow batch function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Windows of a stretch.
STRETCH = 64
SEPARATORS = ["\n\n", "\n", " ", ""]


def windows(text: Column, size: int = 3000, overlap: int = 1000) -> Column:
    """array<struct<chunk_no, content>> of fixed windows; the last one ends with the text.

    A window is cut from a stretch of STRETCH windows and this from the text: finding a place in a text takes time by its distance
    from the start, so cutting every window from the whole would take the square of the length.
    """
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))

    def stretch(j: Column) -> Column:
        first = j * STRETCH
        window = lambda whole: F.transform(F.sequence(F.lit(0), F.least(F.lit(STRETCH), count - first) - 1), lambda i: F.struct((first + i).alias("chunk_no"), F.substr(whole, i * step + 1, F.lit(size)).alias("content")))
        return F.flatten(F.transform(F.array(F.substr(text, first * step + 1, F.lit(STRETCH * step + overlap))), window))  # an array, to name what is cut out

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / STRETCH).cast("int")), stretch))


def split_recursive(text: str, size: int = 3000, overlap: int = 1000, separators: list[str] | None = None) -> list[str]:
    """Chunks by the first separator that occurs, kept at the start of the piece after it; pieces above the size are split again by
    the separators left; pieces are merged up to the size, each chunk beginning with up to `overlap` characters of the one before.
    Without an empty separator, chunks may exceed the size."""
    separators = SEPARATORS if separators is None else separators
    at = next((n for n, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    if separator == "":
        parts = list(text)
    else:
        first, *others = text.split(separator)
        parts = [p for p in [first, *(separator + o for o in others)] if p]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) < size:
            held.append(part)
            continue
        out += _merged(held, size, overlap)
        held = []
        out += split_recursive(part, size, overlap, rest) if rest else [part]
    return out + _merged(held, size, overlap)


def _merged(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    kept: list[str] = []
    total = start = 0
    for part in parts:
        if total + len(part) > size and start < len(kept):
            out.append("".join(kept[start:]))
            while total > overlap or (total + len(part) > size and total > 0):
                total -= len(kept[start])
                start += 1
        kept.append(part)
        total += len(part)
    if start < len(kept):
        out.append("".join(kept[start:]))
    return [c for c in map(str.strip, out) if c]


def recursive(size: int = 3000, overlap: int = 1000, separators: list[str] | None = None):
    """The splitter as a column function: text -> array<string>; null gives null, an empty text an empty array."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap, separators) if t else [], na_action="ignore")

    return run
