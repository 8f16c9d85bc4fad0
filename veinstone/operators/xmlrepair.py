"""Repair of damaged extraction XML: wrong and missing closers, bare characters, unquoted attributes, lost wrappers.

A text is read once as a run of known tags and of characters between them. A stack of open elements and the grammar (which
element may stand in which) tell what each tag means: an opener that has no place where it stands closes what is open there and
opens what it lacks; a closer that fits nothing closes the leaf it stands in. Every element read is written, so none is lost;
prose outside leaves is not. The rewriting depends on order, so it is one pure function over a text, applied in Arrow batches.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The grammar. Each element with the elements it may stand in, the usual one first; none for a section.
PARENTS = {
    "Entitys": (), "Entity": ("Entitys",),
    "EntityId": ("Entity",), "EntityName": ("Entity",), "EntityType": ("Entity",), "EntitySubType": ("Entity",),
    "EntityVariantNames": ("Entity",), "EntityVariantName": ("EntityVariantNames", "Entity"), "Labels": ("Entity",), "Label": ("Labels", "Entity"),
    "Times": ("Entity",), "Time": ("Times", "Entity"), "Properties": ("Entity",), "Property": ("Properties", "Entity"),
    "Relationships": (), "Relationship": ("Relationships",),
    "RelationshipId": ("Relationship",), "RelationshipType": ("Relationship",), "Source": ("Relationship",), "Target": ("Relationship",),
}
SECTIONS = [tag for tag, above in PARENTS.items() if not above]
LEAVES = frozenset(PARENTS) - {above for all_above in PARENTS.values() for above in all_above}
_TAG = re.compile(rf"<(/?)({'|'.join(PARENTS)}|Root)(?=[\s/>])([^<>]*?)(/?)>")
_CUT_TAG = re.compile(r"</?(\w*)$")
_DECLARATION = re.compile(r"\s*(<\?xml[^>]*\?>)")
_BARE = re.compile(r"&(?!#?\w+;)")


def _attributes(tag: str, inside: str) -> str:
    """The attribute of a property, quoted; other elements have none."""
    given = re.match(r"\s*name\s*=\s*(.*)$", inside, re.S)
    if tag != "Property" or not given:
        return ""
    value = given[1].strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    value = _BARE.sub("&amp;", value).replace('"', "&quot;")
    return f' name="{value}"'


class _Writer:
    """The stack of open elements, and what has been written of each section."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.written: dict[str, list[str]] = {}

    def put(self, text: str) -> None:
        if self.open:
            self.written[self.open[0]].append(text)

    def start(self, tag: str, attributes: str = "") -> None:
        above = PARENTS[tag]
        while self.open and self.open[-1] not in above:
            self.end()
        if above and not self.open:
            self.start(above[-1])
        fresh = not above and tag not in self.written
        self.written.setdefault(tag if not above else self.open[0], [])
        self.open.append(tag)
        if above or fresh:  # a section that comes again goes on
            self.put(f"<{tag}{attributes}>")

    def end(self) -> None:
        tag = self.open[-1]
        if PARENTS[tag]:
            self.put(f"</{tag}>")
        self.open.pop()


def _goes_on(tags: list[re.Match], at: int, name: str) -> bool:
    """Whether an element goes on after a closer of its name: what follows may stand only in it, or it is closed once more before
    another of its name opens."""
    if at + 1 < len(tags) and not tags[at + 1][1] and PARENTS.get(tags[at + 1][2]) == (name,):
        return True
    return next((bool(tags[k][1]) for k in range(at + 1, len(tags)) if tags[k][2] == name), False)


def repair(text: str) -> str:
    """The repaired text: a section of entities and one of relations, as far as there are any, after an XML declaration if there
    was one. Text of leaves is escaped, entities in it once more. A text without known elements is escaped as a whole."""
    tags = list(_TAG.finditer(text))
    declared = _DECLARATION.match(text)
    out, at = _Writer(), 0
    for n, tag in enumerate(tags):
        between, at = text[at : tag.start()], tag.end()
        if out.open and out.open[-1] in LEAVES:
            out.put(escape(between))
        elif not between.strip():
            out.put(between)
        closing, name, inside, empty = tag.groups()
        if name == "Root":
            continue
        if not closing:
            out.start(name, _attributes(name, inside))
            if empty:
                out.end()
            continue
        in_leaf = bool(out.open) and out.open[-1] in LEAVES
        if name in out.open and not (in_leaf and name != out.open[-1] and _goes_on(tags, n, name)):
            while out.open[-1] != name:
                out.end()
            out.end()
        elif in_leaf:
            out.end()
    rest = text[at:]
    if out.open and out.open[-1] in LEAVES:
        cut = _CUT_TAG.search(rest)
        out.put(escape(rest[: cut.start()] if cut and any(tag.startswith(cut[1]) for tag in PARENTS) else rest))
    while out.open:
        out.end()
    parts = [declared[1]] if declared else []
    if not out.written:
        return "\n".join([*parts, escape(text[declared.end() :].lstrip("\n") if declared else text)])
    return "\n".join(parts + ["".join([*out.written[s], f"</{s}>"]) for s in SECTIONS if s in out.written])


def validity(text: str) -> tuple[bool, bool, bool]:
    """(valid below one root, has entities, has relations); content with an XML declaration isn't valid below a root."""
    try:
        ET.fromstring(f"<Root>{text}</Root>")
        valid = True
    except ET.ParseError:
        valid = False
    return valid, "<Entity>" in text, "<Relationship>" in text


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair, na_action="ignore")


def repaired(text: Column) -> Column:
    """The repaired text; null stays null, an empty text empty."""
    return _repaired(text)


def unclosed(text: Column) -> Column:
    """map<tag, openers less closers> of the known tags of a text that are not closed as often as opened."""
    count = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    each = [F.struct(F.lit(tag).alias("key"), (count(rf"<{tag}(?:\s[^<>]*)?>") - count(f"</{tag}>")).alias("value")) for tag in PARENTS]
    return F.map_from_entries(F.filter(F.array(*each), lambda e: e["value"] > 0))


def is_valid(text: Column) -> Column:
    """Whether the text parses below one root, with Spark's own XML parser."""
    schema = "Entitys string, Relationships string, _corrupt_record string"
    parsed = F.from_xml(F.concat(F.lit("<Root>"), text, F.lit("</Root>")), schema, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed["_corrupt_record"].isNull(), F.lit(False)) & ~F.coalesce(F.ltrim(text).startswith("<?xml"), F.lit(True))
