"""Constraint, graph and XML queries over entities, relationships and replies, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone import vocab
from veinstone.functions import text as ft
from veinstone.operators import batches, constraints, graph, xmlparse, xmlrepair
from veinstone.operators.components import connected_components
from veinstone.session import once, prepare, stored, table

_ENTITY = ("mention_id", "report_id", "entity_id", "entity_name", "entity_variant_names", "entity_type", "entity_sub_type", "entity_labels", "entity_times", "entity_properties")


def _entities(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    names = columns or _ENTITY
    return once(table(spark, sf_dir, "entities", *dict.fromkeys(("mention_id", *names))), "mention_id").withColumn("pos", F.col("mention_id"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    names = ("relationship_key", "report_id", "relationship_id", "relationship_type", "source_name", "target_name")
    return once(table(spark, sf_dir, "relationships", *names), "relationship_key").withColumn("pos", F.col("relationship_key"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.check_relations(_entities(spark, sf_dir, "report_id", "entity_id", "entity_name", "entity_type"), _relations(spark, sf_dir))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which relations violate the constraints, and what do they become? Counts by relation type."""
    rows = _checked(spark, sf_dir).withColumn("relation", F.lower("relationship_type"))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("relations"), n("valid"), n("fixed"), n("illegal"), n("unresolved"), n("error"))


def constraint_fix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corrected relation, as it was and as it is."""
    return _checked(spark, sf_dir).where("status = 'fixed'").select("relationship_key", "report_id", "relationship_type", "source_type", "target_type", "fixed_type")


def relation_cycle_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation type after each candidate of every pair of types."""
    prepare(spark)
    rows = vocab.candidate_table(spark).select("*", F.explode("candidates").alias("current"))
    return rows.select("source_type", "target_type", "current", constraints.next_in_cycle(F.col("current"), F.col("candidates")).alias("next_type"))


def graph_nodes_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged on label and name, each property the last one given; a list of nulls only reads as null, an empty one as empty."""
    nodes = graph.merge_nodes(_entities(spark, sf_dir))
    text = lambda c: F.when((F.size(c) == 0) | F.exists(c, lambda x: x.isNotNull()), F.array_join(c, ",")).alias(c)
    return nodes.select("label", "name", "id", "subtype", text("labels"), text("variant_names"), text("times"), "properties")


def _nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return graph.bare_nodes(entities).unionByName(graph.missing_endpoints(entities, relations)).distinct()


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = _entities(spark, sf_dir, "report_id", "entity_name", "entity_type"), _relations(spark, sf_dir)
    return graph.merge_edges(_nodes(entities, relations), relations)


def graph_edges_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged on both ends and type, ends resolved by name."""
    return _edges(spark, sf_dir)


def graph_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation ends without an entity in their report."""
    return graph.missing_endpoints(_entities(spark, sf_dir, "report_id", "entity_name"), _relations(spark, sf_dir))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nodes and edges, labels and relation types."""
    entities, relations = _entities(spark, sf_dir, "report_id", "entity_name", "entity_type"), _relations(spark, sf_dir)
    nodes = _nodes(entities, relations)
    return graph.graph_stats(nodes, graph.merge_edges(nodes, relations))


def graph_property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property keys with the number of mentions that have a value."""
    return graph.property_keys(_entities(spark, sf_dir, "entity_properties"))


def graph_khop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within two hops of each report's events, within the report."""
    seeds = _entities(spark, sf_dir, "report_id", "entity_name", "entity_type").where("lower(trim(entity_type)) = 'event' and entity_name is not null").select(F.col("report_id").alias("graph"), F.col("entity_name").alias("start"))
    edges = _relations(spark, sf_dir).where("source_name is not null and target_name is not null").select(F.col("report_id").alias("graph"), F.col("source_name").alias("src"), F.col("target_name").alias("dst"))
    return graph.k_hop(edges, seeds, 2).select(F.col("graph").alias("report_id"), "start", "node", F.col("hops").cast("bigint").alias("hops"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out degree of every node with edges."""
    return graph.degrees(_edges(spark, sf_dir))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected component of every name that a relation joins to another."""
    pairs = _relations(spark, sf_dir).where("source_name is not null and target_name is not null").select(F.col("source_name").alias("a"), F.col("target_name").alias("b"))
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return connected_components(nodes, pairs)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Control characters can't be written in XML; an empty name reads as absent.
    xml = xmlparse.render_reports(_entities(spark, sf_dir), _relations(spark, sf_dir))
    return xml.select("report_id", xmlparse.parse_xml(F.col("xml")).alias("g"))


def xml_roundtrip_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities written as XML by report and parsed back, with all their contents."""
    rows = _round_trip(spark, sf_dir).select("report_id", F.posexplode_outer("g.Entities").alias("pos", "e")).where("e is not null")
    text = lambda c: F.coalesce(F.array_join(f"e.{c}", "|"), F.lit(""))
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("e.Properties")), lambda p: F.concat_ws("=", p["key"], p["value"])), "|")
    return rows.select("report_id", F.col("pos").cast("bigint").alias("pos"), F.col("e.EntityId").alias("entity_id"), F.col("e.EntityName").alias("entity_name"), F.col("e.EntityType").alias("entity_type"), F.col("e.EntitySubType").alias("sub_type"), text("EntityVariantNames").alias("variants"), text("Labels").alias("labels"), text("Times").alias("times"), F.coalesce(facts, F.lit("")).alias("properties"))


def xml_roundtrip_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations written as XML by report and parsed back."""
    rows = _round_trip(spark, sf_dir).select("report_id", F.posexplode_outer("g.Relationships").alias("pos", "r")).where("r is not null")
    return rows.select("report_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.RelationshipId").alias("relationship_id"), F.col("r.RelationshipType").alias("relationship_type"), F.col("r.Source").alias("source_name"), F.col("r.Target").alias("target_name"))


def xml_status_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by completeness of their parsed XML."""
    return _round_trip(spark, sf_dir).select(xmlparse.status_of(F.col("g")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("reports"))


def event_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties with the year and name of their report."""
    reports = once(table(spark, sf_dir, "reports", "report_id", "report_year", "report_name"), "report_id")
    events = _entities(spark, sf_dir, "report_id", "entity_type", "entity_properties").where("entity_type = 'event'").join(reports, "report_id")
    entity = F.struct(F.col("entity_type").alias("EntityType"), F.col("entity_properties").alias("Properties"))
    facts = xmlparse.with_event_facts(entity, F.col("report_year"), F.col("report_name"))
    return events.select("mention_id", facts["observe_time"].alias("observe_time"), facts["report_name"].alias("report_name"), F.coalesce(F.size(facts), F.lit(0)).cast("bigint").alias("properties"))


def tactic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by tactic, with the tactic's name; unknown labels have none."""
    labels = _entities(spark, sf_dir, "entity_labels").select(F.explode("entity_labels").alias("tactic_id")).groupBy("tactic_id").agg(F.count(F.lit(1)).alias("mentions"))
    return labels.join(F.broadcast(vocab.tactic_table(spark)), "tactic_id", "left")


def attack_chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each report in the order of their attack-chain stage."""
    return graph.chain_order(_entities(spark, sf_dir, "report_id", "entity_times")).select("report_id", "mention_id", F.col("stage").cast("bigint").alias("stage"), F.col("place").cast("bigint").alias("place"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return batches.parse_replies(once(table(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id"))


def llm_xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XML that each reply holds."""
    return _replies(spark, sf_dir).where("content is not null").select("response_id", F.md5("xml").alias("xml_md5"))


def xml_repair_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with XML before and after repair: valid, with entities, with relations."""
    rows = _replies(spark, sf_dir).where(F.col("content").contains("<Entit") | F.col("content").contains("<Relation"))
    rows = rows.select("content", xmlrepair.repaired(F.col("xml")).alias("fixed"))
    has = lambda c, tag: F.count_if(F.col(c).contains(f"<{tag}>"))
    return rows.agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(xmlrepair.is_valid(F.col("content"))).alias("valid_before"), F.count_if(xmlrepair.is_valid(F.col("fixed"))).alias("valid_after"),
        has("content", "Entity").alias("entities_before"), has("fixed", "Entity").alias("entities_after"), has("content", "Relationship").alias("relations_before"), has("fixed", "Relationship").alias("relations_after"),
        F.round(100.0 * has("fixed", "Relationship") / F.nullif(has("content", "Relationship"), F.lit(0)), 2).alias("preservation_rate"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        constraint_violations, constraint_fix_rows, relation_cycle_next, graph_nodes_upsert, graph_edges_upsert, graph_missing_endpoints, graph_stats, graph_property_keys, graph_khop2, graph_degree,
        graph_components, xml_roundtrip_entities, xml_roundtrip_relations, xml_status_routing, event_augmentation, tactic_lookup, attack_chain_order, llm_xml_extract, xml_repair_preservation,
    )
}

_TRIPLES = ", ".join(f"({n}, '{r}', '{s}', '{t}')" for n, (r, s, t) in enumerate(vocab.triples()))
_ENT = "ent AS (SELECT DISTINCT ON (mention_id) * FROM entities)"
_REL = "rel AS (SELECT DISTINCT ON (relationship_key) * FROM relationships)"
_CHECKED = f"""WITH {_ENT}, {_REL}, legal(n, relation, s, t) AS (VALUES {_TRIPLES}),
keys AS (SELECT report_id, key, arg_max_null(type, ord) AS type FROM (
  SELECT report_id, entity_id AS key, lower(entity_type) AS type, mention_id * 2 AS ord FROM ent UNION ALL
  SELECT report_id, entity_name, lower(entity_type), mention_id * 2 + 1 FROM ent) WHERE key IS NOT NULL GROUP BY ALL),
cand AS (SELECT s, t, arg_min(relation, n) AS pick FROM legal GROUP BY s, t),
checked AS (SELECT r.*, lower(r.relationship_type) AS relation, a.type AS source_type, b.type AS target_type,
  CASE WHEN a.key IS NULL OR b.key IS NULL THEN 'unresolved' WHEN r.relationship_type IS NULL OR a.type IS NULL OR b.type IS NULL THEN 'error'
       WHEN l.n IS NOT NULL THEN 'valid' WHEN c.pick IS NOT NULL THEN 'fixed' ELSE 'illegal' END AS status, c.pick
  FROM rel r LEFT JOIN keys a ON a.report_id = r.report_id AND a.key = r.source_name LEFT JOIN keys b ON b.report_id = r.report_id AND b.key = r.target_name
  LEFT JOIN legal l ON l.relation = lower(r.relationship_type) AND l.s = a.type AND l.t = b.type LEFT JOIN cand c ON c.s = a.type AND c.t = b.type)"""
_CAP = "upper(left(entity_type, 1)) || lower(substr(entity_type, 2))"
_NODES = f"""nodes AS (SELECT DISTINCT {_CAP} AS label, entity_name AS name FROM ent WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL UNION SELECT 'Entity', name FROM missing),
edges AS (SELECT a.label AS source_label, r.source_name, r.type, b.label AS target_label, r.target_name, r.id FROM (
  SELECT source_name, target_name, upper(relationship_type) AS type, arg_max(relationship_id, relationship_key) AS id FROM rel
  WHERE relationship_id IS NOT NULL AND relationship_type IS NOT NULL AND source_name IS NOT NULL AND target_name IS NOT NULL GROUP BY ALL) r
  JOIN nodes a ON a.name = r.source_name JOIN nodes b ON b.name = r.target_name)"""
_MISSING = """missing AS (SELECT DISTINCT name FROM (SELECT report_id, source_name AS name FROM rel UNION SELECT report_id, target_name FROM rel) e
  WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent x WHERE x.report_id = e.report_id AND x.entity_name = e.name))"""
_GRAPH = f"WITH {_ENT}, {_REL}, {_MISSING}, {_NODES}"
_BY = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("valid", "fixed", "illegal", "unresolved", "error"))
_REPLY = """rep AS (SELECT DISTINCT ON (response_id) response_id, coalesce(response.body.choices[1].message.content, response.choices[1].message.content) AS content FROM batch_responses),
cut AS (SELECT response_id, content, regexp_extract(content, '(?s)<Entitys>.*?</Entitys>') AS e, regexp_extract(content, '(?s)<Relationships>.*?</Relationships>') AS r, regexp_extract(content, '(?s)```xml\\s*(.*?)\\s*```', 1) AS f FROM rep WHERE content IS NOT NULL)"""

_joined = lambda c: f"coalesce(array_to_string(list_filter({c}, lambda x: x IS NOT NULL), '|'), '')"
ORACLES = {
    "constraint_violations": f"{_CHECKED} SELECT relation, count(*) AS relations, {_BY} FROM checked GROUP BY relation",
    "constraint_fix_rows": f"{_CHECKED} SELECT relationship_key, report_id, relationship_type, source_type, target_type, pick AS fixed_type FROM checked WHERE status = 'fixed'",
    "relation_cycle_next": f"WITH legal(n, relation, s, t) AS (VALUES {_TRIPLES}) SELECT s AS source_type, t AS target_type, relation AS current, coalesce(lead(relation) OVER w, first_value(relation) OVER w) AS next_type FROM legal WINDOW w AS (PARTITION BY s, t ORDER BY n)",
    "graph_nodes_upsert": f"""WITH {_ENT} SELECT {_CAP} AS label, entity_name AS name, arg_max(entity_id, mention_id) AS id, arg_max(coalesce(entity_sub_type, ''), mention_id) AS subtype,
  array_to_string(arg_max(entity_labels, mention_id) FILTER (WHERE entity_labels IS NOT NULL), ',') AS labels, array_to_string(arg_max(entity_variant_names, mention_id) FILTER (WHERE entity_variant_names IS NOT NULL), ',') AS variant_names,
  array_to_string(arg_max(entity_times, mention_id) FILTER (WHERE entity_times IS NOT NULL), ',') AS times, CAST(to_json(arg_max(entity_properties, mention_id) FILTER (WHERE entity_properties IS NOT NULL)) AS VARCHAR) AS properties
  FROM ent WHERE entity_id IS NOT NULL AND entity_name IS NOT NULL AND entity_type IS NOT NULL GROUP BY ALL""",
    "graph_edges_upsert": f"{_GRAPH} SELECT * FROM edges",
    "graph_missing_endpoints": f"WITH {_ENT}, {_REL}, {_MISSING} SELECT 'Entity' AS label, name FROM missing",
    "graph_stats": f"{_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM edges) AS types",
    "graph_property_keys": f"WITH {_ENT}, p AS (SELECT unnest(map_entries(entity_properties)) AS e FROM ent WHERE entity_properties IS NOT NULL) SELECT e.key AS key, count(*) AS mentions FROM p WHERE e.value IS NOT NULL GROUP BY ALL",
    "graph_khop2": f"""WITH {_ENT}, {_REL}, s AS (SELECT DISTINCT report_id, entity_name AS start FROM ent WHERE lower(trim(entity_type)) = 'event' AND entity_name IS NOT NULL),
  e AS (SELECT DISTINCT report_id, source_name AS src, target_name AS dst FROM rel WHERE source_name IS NOT NULL AND target_name IS NOT NULL),
  h AS (SELECT report_id, start, start AS node, 0 AS hops FROM s UNION SELECT s.report_id, s.start, e.dst, 1 FROM s JOIN e ON e.report_id = s.report_id AND e.src = s.start
    UNION SELECT s.report_id, s.start, f.dst, 2 FROM s JOIN e ON e.report_id = s.report_id AND e.src = s.start JOIN e f ON f.report_id = s.report_id AND f.src = e.dst)
  SELECT report_id, start, node, CAST(min(hops) AS BIGINT) AS hops FROM h GROUP BY ALL""",
    "graph_components": f"""WITH RECURSIVE {_REL}, e AS (SELECT DISTINCT source_name AS a, target_name AS b FROM rel WHERE source_name IS NOT NULL AND target_name IS NOT NULL),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.seen)
  SELECT node, min(seen) AS component FROM reach GROUP BY node""",
    "graph_degree": f"{_GRAPH}, d AS (SELECT source_label AS label, source_name AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_label, target_name, 0, 1 FROM edges) SELECT label, name, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM d GROUP BY ALL",
    "xml_roundtrip_entities": f"""WITH {_ENT} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY mention_id) - 1 AS pos, nullif(entity_id, '') AS entity_id, nullif(entity_name, '') AS entity_name, nullif(entity_type, '') AS entity_type,
  nullif(entity_sub_type, '') AS sub_type, {_joined('entity_variant_names')} AS variants, {_joined('entity_labels')} AS labels, {_joined('entity_times')} AS times,
  coalesce(array_to_string(list_transform(list_sort(map_entries(entity_properties)), lambda p: p.key || '=' || coalesce(p.value, '')), '|'), '') AS properties FROM ent""",
    "xml_roundtrip_relations": f"WITH {_REL} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY relationship_key) - 1 AS pos, nullif(relationship_id, '') AS relationship_id, nullif(relationship_type, '') AS relationship_type, nullif(source_name, '') AS source_name, nullif(target_name, '') AS target_name FROM rel",
    "xml_status_routing": f"""WITH {_ENT}, {_REL}, r AS (SELECT report_id FROM ent UNION SELECT report_id FROM rel) SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM ent e WHERE e.report_id = r.report_id) THEN 'MISSING_ENTITIES'
  WHEN NOT EXISTS (SELECT 1 FROM rel e WHERE e.report_id = r.report_id) THEN 'MISSING_RELATIONS' ELSE 'SUCCESS' END AS status, count(*) AS reports FROM r GROUP BY ALL""",
    "event_augmentation": f"""WITH {_ENT}, rp AS (SELECT DISTINCT ON (report_id) report_id, report_year, report_name FROM reports), j AS (SELECT mention_id, entity_properties AS p, report_year, nullif(report_name, '') AS n FROM ent JOIN rp USING (report_id) WHERE entity_type = 'event')
  SELECT mention_id, coalesce(CAST(report_year AS VARCHAR), p['observe_time']) AS observe_time, coalesce(n, p['report_name']) AS report_name,
  CAST(coalesce(cardinality(p), 0) + (report_year IS NOT NULL AND NOT coalesce(list_contains(map_keys(p), 'observe_time'), false))::INT + (n IS NOT NULL AND NOT coalesce(list_contains(map_keys(p), 'report_name'), false))::INT AS BIGINT) AS properties FROM j""",
    "tactic_lookup": f"WITH {_ENT}, names(tactic_id, tactic_name) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in vocab.TACTICS.items())}), l AS (SELECT unnest(entity_labels) AS tactic_id FROM ent) SELECT l.tactic_id, count(*) AS mentions, tactic_name FROM l LEFT JOIN names n ON n.tactic_id = l.tactic_id GROUP BY ALL",
    "attack_chain_order": f"""WITH {_ENT}, s AS (SELECT report_id, mention_id, CAST(trim(list_filter(entity_times, lambda t: regexp_full_match(t, '\\s*\\d{{1,2}}\\s*'))[1]) AS BIGINT) AS stage FROM ent)
  SELECT report_id, mention_id, stage, dense_rank() OVER (PARTITION BY report_id ORDER BY stage) AS place FROM s WHERE stage IS NOT NULL""",
    "llm_xml_extract": f"WITH {_REPLY} SELECT response_id, md5(CASE WHEN e <> '' OR r <> '' THEN (CASE WHEN e <> '' THEN e || chr(10) ELSE '' END) || r WHEN f <> '' THEN f ELSE content END) AS xml_md5 FROM cut",
}
