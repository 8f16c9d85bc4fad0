"""Extraction XML to report graphs and back, with Spark's built-in XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROPERTY = "array<struct<_name: string, _VALUE: string>>"
_ENTITY = (
    "EntityId: string, EntityName: string, EntityType: string, EntitySubType: string, "
    "EntityVariantNames: struct<EntityVariantName: array<string>>, EntityVariantName: array<string>, Labels: struct<Label: array<string>>, Label: array<string>, "
    f"Times: struct<Time: array<string>>, Time: array<string>, Properties: struct<Property: {_PROPERTY}>, Property: {_PROPERTY}"
)
_RELATION = "RelationshipId: string, RelationshipType: string, Source: string, Target: string"
_ITEMS = {"Entity": f"array<struct<{_ENTITY}>>", "Relationship": f"array<struct<{_RELATION}>>"}
_SECTIONS = {"Entity": "Entitys", "Relationship": "Relationships"}
#: What may stand below one root: sections, one or more, and items without a section.
SCHEMA = ", ".join(f"{_SECTIONS[i]} array<struct<{i}: {t}>>, {i} {t}" for i, t in _ITEMS.items()) + ", _corrupt_record string"
_OPTIONS = {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt_record"}


def escaped(text: Column) -> Column:
    """Text with markup characters as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def element(tag: str, value: Column) -> Column:
    """An element, nothing for null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{tag}>"), escaped(value), F.lit(f"</{tag}>"))).otherwise("")


def _list(tag: str, item: str, values: Column) -> Column:
    inner = F.array_join(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: element(item, v)), "")
    return F.when(values.isNotNull(), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise("")


def entity_xml() -> Column:
    """One Entity element from columns entity_id, entity_name, entity_type, entity_sub_type and the three arrays and the map."""
    pairs = F.transform(F.map_entries("entity_properties"), lambda p: F.concat(F.lit('<Property name="'), escaped(p["key"]), F.lit('">'), escaped(F.coalesce(p["value"], F.lit(""))), F.lit("</Property>")))
    properties = F.when(F.col("entity_properties").isNotNull(), F.concat(F.lit("<Properties>"), F.array_join(pairs, ""), F.lit("</Properties>"))).otherwise("")
    scalars = [element(tag, F.col(c)) for tag, c in (("EntityId", "entity_id"), ("EntityName", "entity_name"), ("EntityType", "entity_type"), ("EntitySubType", "entity_sub_type"))]
    lists = [_list("EntityVariantNames", "EntityVariantName", F.col("entity_variant_names")), _list("Labels", "Label", F.col("entity_labels")), _list("Times", "Time", F.col("entity_times"))]
    return F.concat(F.lit("<Entity>"), *scalars, *lists, properties, F.lit("</Entity>"))


def relation_xml() -> Column:
    """One Relationship element from columns relationship_id, relationship_type, source_name, target_name."""
    parts = [element(tag, F.col(c)) for tag, c in (("RelationshipId", "relationship_id"), ("RelationshipType", "relationship_type"), ("Source", "source_name"), ("Target", "target_name"))]
    return F.concat(F.lit("<Relationship>"), *parts, F.lit("</Relationship>"))


def rooted(text: Column) -> Column:
    """The text under one root, which may be its own: of two roots the second would silently be lost."""
    whole = F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>\s*", "")
    return F.when(whole.rlike(r"(?s)^<Root>.*</Root>\s*$"), whole).otherwise(F.concat(F.lit("<Root>"), whole, F.lit("</Root>")))


def _named(value: Column, f) -> Column:
    """f of a value that is bound to a name, so that it is made once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _whole(raw: Column) -> Column:
    return F.coalesce(raw.isNotNull() & raw["_corrupt_record"].isNull(), F.lit(False))


def _items(raw: Column, item: str) -> Column:
    """All items of one kind of what was parsed, those in sections first; null if there is neither section nor item."""
    empty = F.array().cast(_ITEMS[item])
    inside = F.flatten(F.transform(raw[_SECTIONS[item]], lambda s: F.coalesce(s[item], empty)))
    either = raw[_SECTIONS[item]].isNotNull() | raw[item].isNotNull()
    return F.when(either, F.concat(F.coalesce(inside, empty), F.coalesce(raw[item], empty)))


def parse_xml(text: Column) -> Column:
    """struct<Entities, Relationships, error>: the text is parsed as a whole; if it is broken, each section by itself, so that a
    damaged one takes nothing from the other. Wrapper elements come first, direct children serve where the wrapper is absent; of
    repeated property names the last holds; a null property value is an empty string; error means that nothing could be read."""
    return _named(text, _parsed)  # the text, too, so that none of what it is made of is asked for inside


def _parsed(text: Column) -> Column:
    """What `parse_xml` gives for a text that has a name."""
    read = lambda x: F.from_xml(x, SCHEMA, _OPTIONS)
    section = lambda s: F.concat(F.lit("<Root>"), F.regexp_extract(text, rf"(?s)<{s}>.*?</{s}>", 0), F.lit("</Root>"))
    alone = lambda item: _named(read(section(_SECTIONS[item])), lambda raw: F.when(_whole(raw), _items(raw, item)))
    parts = lambda entities, relations, whole: F.struct(entities.alias("e"), relations.alias("r"), F.lit(whole).alias("whole"))
    found = _named(read(rooted(text)), lambda raw: F.when(_whole(raw), parts(_items(raw, "Entity"), _items(raw, "Relationship"), True)).otherwise(parts(alone("Entity"), alone("Relationship"), False)))
    blank = lambda c: F.nullif(c, F.lit(""))

    def entity(e: Column) -> Column:
        named = F.filter(F.coalesce(e["Properties"]["Property"], e["Property"]), lambda p: p["_name"].isNotNull())
        pairs = F.map_from_entries(F.transform(named, lambda p: F.struct(p["_name"].alias("key"), F.coalesce(p["_VALUE"], F.lit("")).alias("value"))))
        return F.struct(
            blank(e["EntityId"]).alias("EntityId"), blank(e["EntityName"]).alias("EntityName"), blank(e["EntityType"]).alias("EntityType"), blank(e["EntitySubType"]).alias("EntitySubType"),
            F.coalesce(e["EntityVariantNames"]["EntityVariantName"], e["EntityVariantName"]).alias("EntityVariantNames"), F.coalesce(e["Labels"]["Label"], e["Label"]).alias("Labels"),
            F.coalesce(e["Times"]["Time"], e["Time"]).alias("Times"), pairs.alias("Properties"),
        )

    relation = lambda r: F.struct(*[blank(r[c]).alias(c) for c in ("RelationshipId", "RelationshipType", "Source", "Target")])
    error = lambda p: ~p["whole"] & p["e"].isNull() & p["r"].isNull()
    return _named(found, lambda p: F.struct(F.transform(p["e"], entity).alias("Entities"), F.transform(p["r"], relation).alias("Relationships"), F.coalesce(error(p), F.lit(True)).alias("error")))


def status_of(graph: Column) -> Column:
    """ERROR, MISSING_ENTITIES, MISSING_RELATIONS or SUCCESS."""
    none = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    return F.when(graph["error"], "ERROR").when(none(graph["Entities"]), "MISSING_ENTITIES").when(none(graph["Relationships"]), "MISSING_RELATIONS").otherwise("SUCCESS")


def with_event_facts(entity: Column, year: Column, name: Column) -> Column:
    """The properties of an entity of type event with observe_time and report_name set where they are given, over what was there."""
    facts = F.map_filter(F.create_map(F.lit("observe_time"), F.nullif(year.cast("string"), F.lit("")), F.lit("report_name"), F.nullif(name, F.lit(""))), lambda _, v: v.isNotNull())
    whole = F.map_concat(F.coalesce(entity["Properties"], F.create_map().cast("map<string,string>")), facts)
    return F.when(entity["EntityType"] == "event", F.when(F.size(whole) > 0, whole)).otherwise(entity["Properties"])


def render_reports(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(report_id, xml): each report's entities and relations as extraction XML, in key order."""
    lines = entities.select("report_id", F.lit(0).alias("part"), F.col("mention_id").alias("at"), entity_xml().alias("x"))
    lines = lines.unionByName(relations.select("report_id", F.lit(1).alias("part"), F.col("relationship_key").alias("at"), relation_xml().alias("x")))
    by = lines.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "x"))).alias("all"))
    part = lambda n: F.array_join(F.transform(F.filter("all", lambda r: r["part"] == n), lambda r: r["x"]), "")
    wrap = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    return by.select("report_id", F.concat(wrap("Entitys", part(0)), F.lit("\n"), wrap("Relationships", part(1))).alias("xml"))
