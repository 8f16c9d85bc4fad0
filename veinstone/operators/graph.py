"""Property graph as node and edge tables: merge by key, endpoint resolution, statistics, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def _last(column: str, at: str) -> Column:
    return F.expr(f"max_by({column}, {at}) FILTER (WHERE {column} IS NOT NULL)").alias(column)


def bare_nodes(entities: DataFrame) -> DataFrame:
    """(label, name), one row each, of entities that have a name and a type."""
    return entities.where("entity_name is not null and entity_type is not null").select(capitalise(F.col("entity_type")).alias("label"), F.col("entity_name").alias("name")).distinct()


def merge_nodes(entities: DataFrame) -> DataFrame:
    """Nodes merged on (label, name): every property is the last one given that is not null, in the order of `pos`. Only entities
    with id, name and type take part; subtype defaults to an empty string."""
    rows = entities.where("entity_id is not null and entity_name is not null and entity_type is not null").select(
        capitalise(F.col("entity_type")).alias("label"), F.col("entity_name").alias("name"), "pos", F.col("entity_id").alias("id"),
        F.coalesce("entity_sub_type", F.lit("")).alias("subtype"), F.to_json("entity_properties").alias("properties"), F.col("entity_labels").alias("labels"), F.col("entity_variant_names").alias("variant_names"), F.col("entity_times").alias("times"),
    )
    return rows.groupBy("label", "name").agg(*[_last(c, "pos") for c in ("id", "subtype", "properties", "labels", "variant_names", "times")])


def missing_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(label, name) of relation ends that no entity of the same report is named: bare nodes labelled Entity."""
    ends = relations.select("report_id", F.col("source_name").alias("name")).unionByName(relations.select("report_id", F.col("target_name").alias("name"))).where("name is not null")
    names = entities.select("report_id", F.col("entity_name").alias("name"))
    return ends.join(names, ["report_id", "name"], "left_anti").select(F.lit("Entity").alias("label"), "name").distinct()


def merge_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges merged on (source label, source, type, target label, target), with the id given last. Endpoints match every node of
    the name, whatever its label; a relation needs id, type and both ends.

    Relations are merged by names first, so that homonyms multiply distinct edges only, not mentions.
    """
    whole = relations.where("relationship_id is not null and relationship_type is not null and source_name is not null and target_name is not null")
    named = whole.groupBy("source_name", "target_name", F.upper("relationship_type").alias("type")).agg(F.max_by("relationship_id", "pos").alias("id"), F.max("pos").alias("pos"))
    end = lambda x: nodes.select(F.col("name").alias(f"{x}_name"), F.col("label").alias(f"{x}_label"))
    return named.join(end("source"), "source_name").join(end("target"), "target_name").select("source_label", "source_name", "type", "target_label", "target_name", "id")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the sorted labels and relation types."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    return n.crossJoin(e)  # one row each


def property_keys(entities: DataFrame) -> DataFrame:
    """Keys of properties that hold a value, with the number of mentions."""
    pairs = entities.where("entity_properties is not null").select(F.explode("entity_properties").alias("key", "value"))
    return pairs.where("value is not null").groupBy("key").agg(F.count(F.lit(1)).alias("mentions"))


def clear_graph(nodes: DataFrame, edges: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables emptied, if confirmed; else as they are."""
    return (nodes.limit(0), edges.limit(0)) if confirm else (nodes, edges)


def clear_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what a clearing would remove, that is nodes, edges, labels and types, and property keys with a value."""
    kinds = graph_stats(nodes, edges)
    filled = nodes.agg(*[F.count_if(F.col(c).isNotNull()).alias(c) for c in nodes.columns if c not in ("label", "name")])
    keys = F.array_join(F.filter(F.array(*[F.when(F.col(c) > 0, c) for c in filled.columns]), lambda c: c.isNotNull()), ",") if filled.columns else F.lit("")
    return kinds.crossJoin(filled.select(keys.alias("keys")))  # one row each


def clear_properties(nodes: DataFrame, keep: tuple[str, ...] = ("label", "name")) -> DataFrame:
    """All columns but the key set to null."""
    return nodes.select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes])


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(graph, start, node, hops): nodes within `hops` of each seed along directed edges(graph, src, dst), with the least number
    of hops; seeds(graph, start). A round is one join and one minimum; lineage is cut after each."""
    found = seeds.select("graph", "start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    steps = edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    for hop in range(1, hops + 1):
        front = found.where(F.col("hops") == hop - 1).join(steps, ["graph", "node"]).select("graph", "start", F.col("_to").alias("node"), F.lit(hop).alias("hops"))
        found = found.unionByName(front).groupBy("graph", "start", "node").agg(F.min("hops").alias("hops"))
        if hop < hops:
            found = cut(found)
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """(label, name, out_degree, in_degree)."""
    out = edges.select(F.col("source_label").alias("label"), F.col("source_name").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("target_label").alias("label"), F.col("target_name").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("label", "name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def chain_order(entities: DataFrame) -> DataFrame:
    """(report_id, mention_id, stage, place): entities of a report in the order of their attack-chain stage, the first item of
    entity_times that is a number of at most two digits."""
    stage = F.filter("entity_times", lambda t: t.rlike(r"^\s*\d{1,2}\s*$"))
    rows = entities.select("report_id", F.col("pos").alias("mention_id"), F.get(stage, F.lit(0)).cast("int").alias("stage")).where("stage is not null")
    from pyspark.sql import Window

    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("report_id").orderBy("stage")))
