"""Deeply nested graph records to related flat tables: one depth-first pass per record emits tagged rows.

A row carries its table's tag, a primary key, the key of its parent and its payload; typed tables are projections of the tagged
rows, and `write_tables` stores them partitioned by tag, so that reading one table prunes the rest. Keys are paths
(`<graph>/<graph_no>/e<pos>/...`), hence unique and readable without a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.nested import parse_json

TAGS = ("entity", "relationship", "variant", "Labels", "Times", "Properties", "RelationshipType")
SCHEMA = "tag string, graph_id bigint, pk string, parent_pk string, parent_pos bigint, item_key string, item_value string, payload map<string,string>"
_ARROW = pa.schema([("tag", pa.string()), ("graph_id", pa.int64()), ("pk", pa.string()), ("parent_pk", pa.string()), ("parent_pos", pa.int64()), ("item_key", pa.string()), ("item_value", pa.string()), ("payload", pa.map_(pa.string(), pa.string()))])
#: The names that wrap a list of items, by field.
WRAPPERS = {"Labels": ("Labels", "Label"), "Times": ("Times", "Time"), "Entities": ("Entity",), "Relationships": ("Relationship",), "EntityVariantNames": ("EntityVariantNames", "EntityVariantName")}
_NAME, _VALUE = ("@name", "name"), ("#text", "value", "@value")


def _text(value: object) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def _parse(text: str | None) -> object:
    """The JSON value with its numbers as written, None if the text is not whole JSON."""
    try:
        return parse_json(text) if text else None
    except ValueError:
        return None


def graphs(value: object) -> Iterator[dict]:
    """Every object with Entities or Relationships, in document order, also inside strings that hold JSON."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            v = _parse(v) if v.lstrip()[:1] in ("{", "[") else None
        if isinstance(v, dict):
            if "Entities" in v or "Relationships" in v:
                yield v
            else:
                stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of each leaf, depth first; nulls and empty containers give none."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{at}.{k}" if at else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{at}.{n}" if at else str(n), x) for n, x in reversed(list(enumerate(v))))
        elif v is not None:
            yield at, _text(v)


def _unwrap(value: object, field: str) -> object:
    while isinstance(value, dict) and len(value) == 1 and next(iter(value)) in WRAPPERS[field]:
        value = next(iter(value.values()))
    return value


def listed(value: object, field: str) -> list:
    """The items of a field that may be wrapped, a lone item or an array; null gives none."""
    value = _unwrap(value, field)
    return value if isinstance(value, list) else [] if value is None else [value]


def _pair(value: object) -> tuple[str, object] | None:
    """(name, value) of an object that stands for one property."""
    if isinstance(value, dict) and (name := next((k for k in _NAME if k in value), None)) and (set(value) <= {*_NAME, *_VALUE}):
        try:
            return _text(value[name]), next((value[k] for k in _VALUE if k in value), None)
        except RecursionError:  # no name but a deep object: its leaves are given instead
            return None
    return None


def properties(value: object) -> Iterator[tuple[str, str]]:
    """(name, text) of each property leaf in any of the layouts: an object, name-value objects, or these below Property."""
    wrapped = False
    while isinstance(value, dict) and set(value) == {"Property"}:
        value, wrapped = value["Property"], True
    items = value if isinstance(value, list) else [value]
    paired = wrapped or isinstance(value, list)
    for item in items:
        pair = _pair(item) if paired else None
        yield from leaves(pair[1], pair[0]) if pair else leaves(item)


def visit(graph_id: int, text: str | None) -> Iterator[tuple]:
    """The tagged rows of one record, depth first."""
    for number, graph in enumerate(graphs(_parse(text))):
        root = f"{graph_id}/{number}"
        for kind, field, letter in (("entity", "Entities", "e"), ("relationship", "Relationships", "r")):
            for pos, item in enumerate(listed(graph.get(field), field)):
                if not isinstance(item, dict):
                    continue
                pk = f"{root}/{letter}{pos}"
                flat = [(k, _text(v)) for k, v in item.items() if v is not None and not isinstance(v, (dict, list)) and k not in ("Labels", "Times", "EntityVariantNames")]
                yield kind, graph_id, pk, root, pos, None, None, flat
                if kind == "relationship":
                    kind_text = item.get("RelationshipType")
                    if kind_text is not None and not isinstance(kind_text, (dict, list)):
                        yield "RelationshipType", graph_id, f"{pk}/t", pk, pos, "", _text(kind_text), None
                    continue
                for name, tag in (("EntityVariantNames", "variant"), ("Labels", "Labels"), ("Times", "Times")):
                    for n, x in enumerate(listed(item.get(name), name)):
                        for at, leaf in leaves(_unwrap(x, name)):
                            key = f"{n}.{at}" if at else str(n)
                            yield tag, graph_id, f"{pk}/{tag}/{key}", pk, pos, key, leaf, None
                for n, (key, leaf) in enumerate(properties(item.get("Properties"))):
                    yield "Properties", graph_id, f"{pk}/Properties/{n}", pk, pos, key, leaf, None


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for graph_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for row in visit(graph_id, text):
                rows.append(row)
                if len(rows) >= 8192:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def flatten_graphs(records: DataFrame, key: str = "graph_id", text: str = "graph_json") -> DataFrame:
    """The tagged rows of all records, in one narrow pass (no shuffle).

    records: one row per key. Null, empty and broken texts give no rows; a lone object counts as position 0; items that are not
    objects are left out but keep their position; an empty table gives an empty result; other columns are not read.
    """
    return records.select(F.col(key).cast("bigint").alias("graph_id"), F.col(text).alias("text")).where("text is not null").mapInArrow(_emit, SCHEMA)


def tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """The flat tables as typed projections of the tagged rows."""
    entity = [F.col("payload")[c].alias(n) for c, n in (("EntityId", "entity_id"), ("EntityName", "entity_name"), ("EntityType", "entity_type"), ("EntitySubType", "entity_sub_type"))]
    relation = [F.col("payload")[c].alias(n) for c, n in (("RelationshipId", "relationship_id"), ("RelationshipType", "relationship_type"), ("Source", "source_name"), ("Target", "target_name"))]
    at = ["graph_id", "pk", "parent_pk", "parent_pos"]
    of = lambda tag: tagged.where(F.col("tag") == tag)
    item = lambda tag, name: of(tag).select(*at, F.col("item_key").alias("pos" if name != "value" else "name"), F.col("item_value").alias(name))
    return {
        "entities": of("entity").select(*at, *entity),
        "relationships": of("relationship").select(*at, *relation),
        "variants": item("variant", "variant_name"),
        "labels": item("Labels", "label"),
        "times": item("Times", "time"),
        "properties": item("Properties", "value"),
    }


def write_tables(tagged: DataFrame, path: str, shards: int | None = None) -> None:
    """Store the tagged rows partitioned by tag, each tag in at most `shards` files (by default as many as the session's shuffle
    partitions): rows move to the task of their tag and shard, so no task writes a file for every tag."""
    shards = shards or int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("pk"), F.lit(shards))
    tagged.repartition(shards, "tag", shard).write.partitionBy("tag").parquet(path, mode="overwrite")
