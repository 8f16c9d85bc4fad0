"""Incremental ingestion: manifests, content-addressed files, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_delta(current: DataFrame, known: DataFrame, key: str = "file") -> DataFrame:
    """(key, change): files that are new, and known ones that are gone."""
    now, then = current.select(key).distinct(), known.select(key).distinct()
    return now.join(then, key, "left_anti").withColumn("change", F.lit("new")).unionByName(then.join(now, key, "left_anti").withColumn("change", F.lit("deleted")))


def content_addressed(files: DataFrame, key: str, content: str, name: str | None = None) -> DataFrame:
    """(hash, first_key, copies, size): one row per distinct content; the least key names it."""
    hashed = files.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("hash"), F.col(key).alias("k"), F.octet_length(content).alias("s"))
    return hashed.groupBy("hash").agg(F.min("k").alias("first_key"), F.count(F.lit(1)).alias("copies"), F.first("s").cast("bigint").alias("size"))


def upsert(manifest: DataFrame, update: DataFrame, key: str | list[str], at: str) -> DataFrame:
    """Both tables together, of equal keys the row that is last by `at`; of rows at the same time, any."""
    both, keys = manifest.unionByName(update), [key] if isinstance(key, str) else key
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def verify(files: DataFrame, content: str, expected: str) -> DataFrame:
    """files with ok: whether the SHA-1 of the content is the expected one."""
    return files.withColumn("ok", F.coalesce(F.sha1(F.col(content)) == F.lower(expected), F.lit(False)))


def not_yet(index: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entries of the index that are not done."""
    return index.join(done.select(key).distinct(), key, "left_anti")
