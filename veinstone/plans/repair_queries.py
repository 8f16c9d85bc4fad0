"""Every report's extraction XML damaged in one way, repaired and parsed: the entities and relations must be those of the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import xmlparse, xmlrepair
from veinstone.plans.graph_queries import _ENT, _REL, _entities, _relations

_sub = lambda pattern, by: lambda x: F.regexp_replace(x, pattern, by)
_raw = lambda x: F.replace(F.replace(F.replace(x, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
_relations_cut = lambda x, kept: F.concat(F.split_part(x, F.lit("<Relationships>"), F.lit(1)), F.lit(kept))
_LAST = "<Relationships><Relationship><RelationshipId>r</RelationshipId><RelationshipType>use</RelationshipType><Source>a</Source><Target>b"
#: Kind of damage and how it is done to whole XML.
DAMAGE = {
    "wrong_closer": _sub("</RelationshipId>", "</RelationshipType>"),
    "leaf_open_at_end": lambda x: _relations_cut(x, _LAST),
    "parents_open_at_end": _sub(r"(</Relationship>)?</Relationships>\s*$", ""),
    "no_entity_wrapper": _sub("</?Entitys>", ""),
    "no_relation_wrapper": _sub("</?Relationships>", ""),
    "declaration": lambda x: F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), x),
    "unquoted_attribute": _sub('name="([^"]*)"', "name=$1"),
    "raw_characters": _raw,
    "escaped_before": lambda x: x,
    "entities_only": lambda x: F.split_part(x, F.lit("<Relationships>"), F.lit(1)),
    "relations_only": lambda x: F.concat(F.lit("<Relationships>"), F.split_part(x, F.lit("<Relationships>"), F.lit(2))),
    "neither": lambda x: F.lit("No entities & no relations were found."),
    "prose_around": lambda x: F.concat(F.lit("Here is the result:\n\n"), x, F.lit("\n\nTell me if you need more.")),
    "fenced": lambda x: F.concat(F.lit("```xml\n"), x, F.lit("\n```")),
}


def _rows(graphs: DataFrame) -> DataFrame:
    """(report_id, kind, pos, id, name, type, facts) of parsed graphs."""
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    facts = F.transform(F.array_sort(F.map_entries("i.Properties")), lambda p: F.concat_ws("=", p["key"], p["value"]))
    entities = graphs.select("report_id", F.posexplode_outer("g.Entities").alias("pos", "i")).where("i is not null")
    entities = entities.select("report_id", F.lit("entity").alias("kind"), "pos", F.col("i.EntityId").alias("id"), F.col("i.EntityName").alias("name"), F.col("i.EntityType").alias("type"), F.concat_ws("#", text("i.Labels"), text("i.Times"), text(facts)).alias("facts"))
    relations = graphs.select("report_id", F.posexplode_outer("g.Relationships").alias("pos", "i")).where("i is not null")
    relations = relations.select("report_id", F.lit("relation").alias("kind"), "pos", F.col("i.RelationshipId").alias("id"), F.concat_ws(">", "i.Source", "i.Target").alias("name"), F.col("i.RelationshipType").alias("type"), F.lit("").alias("facts"))
    return entities.unionByName(relations).withColumn("pos", F.col("pos").cast("bigint"))


def _damaged(spark: SparkSession, sf_dir: str, change) -> DataFrame:
    xml: Column = change(F.col("xml"))
    return xmlparse.render_reports(_entities(spark, sf_dir), _relations(spark, sf_dir)).select("report_id", xml.alias("xml"))


def _repair(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = _damaged(spark, sf_dir, DAMAGE[kind]).select("report_id", xmlrepair.repaired(F.col("xml")).alias("xml"))
    return _rows(rows.select("report_id", xmlparse.parse_xml(F.col("xml")).alias("g")))


def xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with one damaged section, read without repair: the other section survives."""
    change = lambda x: F.when(F.col("report_id") % 2 == 0, F.regexp_replace(x, "</Source>", "")).otherwise(F.regexp_replace(x, "</EntityId>", ""))
    rows = _damaged(spark, sf_dir, change).select("report_id", xmlparse.parse_xml(F.col("xml")).alias("g"))
    return rows.select("report_id", xmlparse.status_of(F.col("g")).alias("status"), F.coalesce(F.size("g.Entities"), F.lit(0)).cast("bigint").alias("entities"), F.coalesce(F.size("g.Relationships"), F.lit(0)).cast("bigint").alias("relations"))


def xml_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tags of each kind all reports leave open if every entity name loses its closer, and one relation is cut off."""
    change = lambda x: _relations_cut(F.regexp_replace(x, "</EntityName>", ""), _LAST)
    rows = _damaged(spark, sf_dir, change).select(F.explode(xmlrepair.unclosed(F.col("xml"))).alias("tag", "n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("unclosed"))


QUERIES = {f"xml_repair_{kind}": partial(_repair, kind=kind) for kind in DAMAGE} | {"xml_sections": xml_sections, "xml_unclosed": xml_unclosed}


def _esc(x: str, marks: str = "&<>\"") -> str:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{mark}', '{name}')" if mark in marks else x
    return x


def _wanted(kind: str) -> str:
    """The rows of the tables: values are as they were escaped in the XML, since repair escapes once more."""
    e = (lambda x: _esc(x, "<")) if kind == "raw_characters" else _esc
    item = lambda c: f"coalesce(array_to_string(list_transform(list_filter({c}, lambda x: x IS NOT NULL), lambda x: {e('x')}), '|'), '')"
    facts = f"coalesce(array_to_string(list_transform(list_sort(map_entries(entity_properties)), lambda p: p.key || '=' || {e(chr(39) * 2 + ' || coalesce(p.value, ' + chr(39) * 2 + ')')}), '|'), '')"
    blank = lambda c: f"nullif({e(c)}, '')"
    ent = f"""SELECT report_id, 'entity' AS kind, row_number() OVER (PARTITION BY report_id ORDER BY mention_id) - 1 AS pos, {blank('entity_id')} AS id, {blank('entity_name')} AS name, {blank('entity_type')} AS type,
  {item('entity_labels')} || '#' || {item('entity_times')} || '#' || {facts} AS facts FROM ent"""
    name = f"concat_ws('>', {blank('source_name')}, {blank('target_name')})"
    rel = f"SELECT report_id, 'relation' AS kind, row_number() OVER (PARTITION BY report_id ORDER BY relationship_key) - 1 AS pos, {blank('relationship_id')} AS id, {name} AS name, {blank('relationship_type')} AS type, '' AS facts FROM rel"
    if kind == "leaf_open_at_end":
        rel = "SELECT report_id, 'relation', 0, 'r', 'a>b', 'use', '' FROM (SELECT report_id FROM ent UNION SELECT report_id FROM rel)"
    parts = {"entities_only": [ent], "relations_only": [rel], "neither": [f"SELECT * FROM ({ent}) WHERE false"]}.get(kind, [ent, rel])
    return f"WITH {_ENT}, {_REL} " + " UNION ALL ".join(parts)


ORACLES = {f"xml_repair_{kind}": _wanted(kind) for kind in DAMAGE}
ORACLES["xml_sections"] = f"""WITH {_ENT}, {_REL}, r AS (SELECT report_id FROM ent UNION SELECT report_id FROM rel),
  n AS (SELECT report_id, (SELECT count(*) FROM ent e WHERE e.report_id = r.report_id) AS e, (SELECT count(*) FROM rel l WHERE l.report_id = r.report_id) AS l,
    (SELECT count(entity_id) FROM ent e WHERE e.report_id = r.report_id) AS ids, (SELECT count(source_name) FROM rel l WHERE l.report_id = r.report_id) AS sources FROM r),
  m AS (SELECT report_id, report_id % 2 = 0 AND sources > 0 AS bad_l, report_id % 2 <> 0 AND ids > 0 AS bad_e, e, l FROM n)
  SELECT report_id, CASE WHEN bad_e OR e = 0 AND (bad_l OR l > 0) THEN 'MISSING_ENTITIES' WHEN bad_l OR l = 0 THEN 'MISSING_RELATIONS' ELSE 'SUCCESS' END AS status, CASE WHEN bad_e THEN 0 ELSE e END AS entities, CASE WHEN bad_l THEN 0 ELSE l END AS relations FROM m"""
ORACLES["xml_unclosed"] = f"""WITH {_ENT}, {_REL}, r AS (SELECT report_id FROM ent UNION SELECT report_id FROM rel)
  SELECT 'EntityName' AS tag, count(entity_name) AS unclosed FROM ent UNION ALL SELECT t, (SELECT count(*) FROM r) FROM (SELECT unnest(['Relationships', 'Relationship', 'Target']) AS t)"""
