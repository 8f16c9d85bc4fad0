"""All core queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinstone.plans import core_problems, graph_queries, io_queries, repair_queries, text_queries

_MODULES = (core_problems, graph_queries, io_queries, repair_queries, text_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["constraint_violations"](spark, sf_dir)
