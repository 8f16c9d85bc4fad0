"""Queries of the core's problems 4 and 7 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import flatten, timestamps
from veinstone.session import once, prepare, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of entity_times that gives an instant, once per mention."""
    prepare(spark)
    mentions = once(table(spark, sf_dir, "entities", "mention_id", "feed_code", "entity_times").where(F.size("entity_times") > 0), "mention_id")
    times = timestamps.normalise_times(mentions, table(spark, sf_dir, "feeds", "feed_code", "home_zone", "date_order"))
    return times.select("mention_id", F.col("time_pos").cast("bigint").alias("time_pos"), "utc_us")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return flatten.flatten_graphs(once(table(spark, sf_dir, "report_graphs", "graph_id", "graph_json"), "graph_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaf below Labels, Times or Properties and per RelationshipType."""
    rows = _tagged(spark, sf_dir).where(F.col("tag").isin("Labels", "Times", "Properties", "RelationshipType"))
    return rows.select("graph_id", "parent_pos", F.col("tag").alias("field_name"), "item_key", "item_value")


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat entity table with its number of children of each kind, by parent key."""
    tagged = _tagged(spark, sf_dir)
    of = lambda tag: F.count_if(F.col("tag") == tag)
    parent = F.when(F.col("tag") == "entity", F.col("pk")).otherwise(F.col("parent_pk"))
    rows = tagged.where(~F.col("tag").isin("relationship", "RelationshipType")).groupBy("graph_id", parent.alias("entity_pk"))
    name = F.max(F.when(F.col("tag") == "entity", F.col("payload")["EntityName"])).alias("entity_name")
    return rows.agg(name, of("Labels").alias("labels"), of("Times").alias("times"), of("Properties").alias("properties"))


QUERIES = {"p4_found": p4_found, "p7_found": p7_found, "p7_entities": p7_entities}
ORACLES: dict[str, str] = {}
