"""Validation and correction of typed relations against the constraint table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone import vocab


def entity_keys(entities: DataFrame) -> DataFrame:
    """(report_id, key, type): ids and names share one namespace within a report; of equal keys the later entity wins, and of one
    entity its name comes after its id. entities: report_id, pos, entity_id, entity_name, entity_type."""
    at = F.col("pos") * 2
    kind = F.lower("entity_type")
    ids = entities.select("report_id", F.col("entity_id").alias("key"), kind.alias("type"), at.alias("at"))
    names = entities.select("report_id", F.col("entity_name").alias("key"), kind.alias("type"), (at + 1).alias("at"))
    return ids.unionByName(names).where("key is not null").groupBy("report_id", "key").agg(F.max_by("type", "at").alias("type"))


def check_relations(entities: DataFrame, relations: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Each relation with source_type, target_type, status (valid, fixed, illegal, unresolved, error) and fixed_type.

    A relation of a legal triple is valid as written; an illegal one becomes the first relation legal for its pair of types, in
    lower case; without one it stays. Endpoints unknown in the report leave it unresolved. A null relation or entity type is an
    error of that row only. Both constraint tables are constants of 24 and 21 rows and are broadcast.
    """
    spark = relations.sparkSession
    keys = entity_keys(entities)
    if aliases:
        keys = keys.replace(aliases, subset=["type"])
    end = lambda x: keys.select("report_id", F.col("key").alias(f"{x}_name"), F.col("type").alias(f"{x}_type"), F.lit(True).alias(f"{x}_known"))
    rows = relations.join(end("source"), ["report_id", "source_name"], "left").join(end("target"), ["report_id", "target_name"], "left")
    legal = F.broadcast(vocab.constraint_table(spark).withColumn("legal", F.lit(True)))
    rows = rows.withColumn("relation", F.lower("relationship_type")).join(legal, ["relation", "source_type", "target_type"], "left")
    rows = rows.join(F.broadcast(vocab.candidate_table(spark)), ["source_type", "target_type"], "left")
    known = F.coalesce("source_known", F.lit(False)) & F.coalesce("target_known", F.lit(False))
    status = (
        F.when(~known, "unresolved")
        .when(F.col("relationship_type").isNull() | F.col("source_type").isNull() | F.col("target_type").isNull(), "error")
        .when(F.col("legal"), "valid")
        .when(F.col("candidates").isNotNull(), "fixed")
        .otherwise("illegal")
    )
    rows = rows.withColumn("status", status)
    fixed = F.when(F.col("status") == "fixed", F.element_at("candidates", 1)).otherwise(F.col("relationship_type"))
    return rows.withColumn("fixed_type", fixed).drop("relation", "legal", "candidates", "source_known", "target_known")


def next_in_cycle(current: Column, options: Column) -> Column:
    """The option after `current` in the list, the first after the last; the first if it is not among them."""
    return F.element_at(options, (F.array_position(options, current) % F.size(options) + 1).cast("int"))
