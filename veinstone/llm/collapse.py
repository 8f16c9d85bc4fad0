"""Duplicates hidden by formatting: collapse byte-identical rows first, canonicalise the survivors, group again on the full text.

One pass over the rows collapses byte-identical ones of a task, with counts, and canonicalises what is left; so the raw texts
never move. The canonical texts move once, summed before they do, and are grouped in full; from then on digests stand for them.

Two records are alike if they have the same fields, nested ones included, with the same values, when white space, letter case,
punctuation and the order of fields count for nothing, in names as in values. Array order counts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.nested import parse_json
from veinstone.operators.skew import join_hot
from veinstone.session import stored


class _Fold(dict):
    """Translation table filled as characters come: letters, marks, digits and symbols stay, the rest goes."""

    def __missing__(self, code: int) -> str | None:
        kind = unicodedata.category(chr(code))[0]
        self[code] = chr(code) if kind in "LMNS" else None
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Case folded, without white space, control characters and punctuation."""
    return text.casefold().translate(_FOLD)


def _canon(value: object) -> str:
    """With an explicit stack, so that depth is no limit: a container is joined once its parts are done."""
    stack, done = [(value, False)], []
    while stack:
        v, ready = stack.pop()
        if isinstance(v, (dict, list)) and not ready:
            stack.append((v, True))
            stack.extend((x, False) for x in reversed(v.values() if isinstance(v, dict) else v))
        elif isinstance(v, (dict, list)):
            start = len(done) - len(v)
            parts = done[start:]
            del done[start:]
            if isinstance(v, dict):
                done.append("{" + ",".join(sorted(f"{fold(k)}:{part}" for k, part in zip(v, parts))) + "}")
            else:
                done.append("[" + ",".join(parts) + "]")
        elif v is None:
            done.append("~")
        else:
            done.append('"' + fold("true" if v is True else "false" if v is False else str(v)) + '"')
    return done[0]


def canonical(text: str | None) -> str | None:
    """The canonical text of a JSON record; a text that is not whole JSON stands for itself, folded; None for null."""
    if text is None:
        return None
    try:
        return _canon(parse_json(text))
    except ValueError:
        return "!" + fold(text)


#: Different texts a task remembers; one that comes again after it was forgotten is collapsed with the others later.
REMEMBERED = 50_000


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row (id, class): the digest of its canonical text; per different text of the task (class, canon, n, first): the canonical
    text, the number of its rows, and the least id of these."""
    schema = pa.schema([("id", pa.int64()), ("class", pa.binary()), ("canon", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
    known: dict[str, tuple[str, bytes]] = {}
    groups: dict[str, list[int]] = {}

    def survivors() -> pa.RecordBatch:
        kept = [known[raw] for raw in groups]
        counts, firsts = [g[0] for g in groups.values()], [g[1] for g in groups.values()]
        none = pa.nulls(len(kept), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array([d for _, d in kept], pa.binary()), pa.array([c for c, _ in kept], pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], schema=schema)

    for batch in batches:
        ids, classes = batch.column(0).to_pylist(), []
        for key, raw in zip(ids, batch.column(1).to_pylist()):
            if raw not in known:
                text = canonical(raw)
                known[raw] = (text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16])
            classes.append(known[raw][1])
            if (group := groups.get(raw)) is None:
                groups[raw] = [1, key]
            else:
                group[0] += 1
                group[1] = min(group[1], key)
        rest = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(len(ids), pa.string()), rest, rest], schema=schema)
        if len(known) > REMEMBERED:
            yield survivors()
            known.clear()
            groups.clear()
    if groups:
        yield survivors()


def collapse(lines: DataFrame, key: str = "line_id", text: str = "raw_entity") -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes(kept, copies, text) has one record of each set alike, the one of the least key, with the number
    of its rows; members(key, kept) has every row with the key kept for it.

    lines may repeat whole rows (same key): each key counts once. Null texts belong to no class; empty texts are alike; broken
    JSON is compared as folded text; an empty table gives empty results; other columns are not read. Hot texts (a third of all
    rows alike) are summed before the shuffle and joined back by broadcast of the hot keys only.
    """
    source = lines.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_raw")).where("_raw is not null")
    passed = stored(source.mapInArrow(_pass, "id bigint, class binary, canon string, n bigint, first bigint"), "canonical")
    rows = passed.where("id is not null").select("id", "class")
    repeats = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("class").alias("class")).where("n > 1").groupBy("class").agg(F.sum(F.col("n") - 1).alias("_more"))
    grouped = passed.where("id is null").groupBy("canon").agg(F.sum("n").alias("rows"), F.min("first").alias("kept"), F.first("class").alias("class"))
    grouped = grouped.select("class", "rows", "kept").join(repeats, "class", "left")
    classes = stored(grouped.select("class", "rows", (F.col("rows") - F.coalesce("_more", F.lit(0))).alias("copies"), "kept"), "classes")
    members = join_hot(rows.dropDuplicates(["id"]), classes.select("class", "rows", "kept"), "class", "rows").select(F.col("id").alias(key), "kept")
    texts = source.join(classes.select(F.col("kept").alias("_id"), "copies"), "_id").groupBy("_id").agg(F.first("copies").alias("copies"), F.first("_raw").alias(text))
    return texts.select(F.col("_id").alias("kept"), "copies", text), members
