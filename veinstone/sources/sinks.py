"""Writers: partitioned tables instead of one file per record, routed by status, merged by key."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_year(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows partitioned by year."""
    rows.write.partitionBy("year").format(kind).save(path, mode="overwrite")


def write_routed(graphs: DataFrame, path: str) -> None:
    """Report graphs partitioned by status and year: SUCCESS and MISSING_RELATIONS are kept, the rest is left out."""
    graphs.where(F.col("status").isin("SUCCESS", "MISSING_RELATIONS")).write.partitionBy("status", "year").json(path, mode="overwrite")


def write_each(rows: DataFrame, root: str, path: str = "path", text: str = "text") -> None:
    """One UTF-8 file per row at root/<path>, written by the workers to a mounted folder; directories are made, null texts are empty
    files. For few or outward files: tables are better kept as tables."""
    base = root.removeprefix("file://")
    if "://" in base:
        raise ValueError("files of their own are written to mounted folders only")

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["text"]):
                target = Path(base, name)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(content or "", encoding="utf-8", newline="")
            yield batch[["path"]]

    rows.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def remove_each(rows: DataFrame, root: str, path: str = "path") -> int:
    """Delete the files root/<path> of a mounted folder, such as downloads that failed their check; how many there were."""
    base = root.removeprefix("file://")
    if "://" in base:
        raise ValueError("files of their own are deleted from mounted folders only")

    import pandas as pd

    def remove(batches):
        for batch in batches:
            there = [p for name in batch["path"] if (p := Path(base, name)).is_file()]
            for p in there:
                p.unlink(missing_ok=True)
            yield pd.DataFrame({"n": [len(there)]})

    return rows.select(F.col(path).alias("path")).mapInPandas(remove, "n long").agg(F.sum("n")).first()[0] or 0


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    """One JSON line per row."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    stats.coalesce(1).write.json(path, mode="overwrite")


def chunks_with_number(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with a number that is dense over the whole batch, in the given order.

    Numbering needs no single task: rows are range-sorted, partitions counted, and each row gets its partition's offset plus its
    place in it.
    """
    import pandas as pd

    from veinstone.session import cut

    def place(batches):
        seen = 0
        for batch in batches:
            yield batch.assign(_at=range(seen, seen + len(batch)))
            seen += len(batch)

    ranged = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{n}` {t}" for n, t in ranged.dtypes) + ", _at bigint"
    placed = cut(ranged.mapInPandas(place, schema))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row per partition
    starts, total = [], 0
    for part, many in counts:
        starts.append((part, total))
        total += many
    offsets = chunks.sparkSession.createDataFrame(pd.DataFrame(starts, columns=["_part", "_from"]).astype({"_part": "int32", "_from": "int64"})) if starts else placed.select("_part", F.col("_at").alias("_from")).limit(0)
    return placed.join(F.broadcast(offsets), "_part").withColumn("chunk_id", F.col("_from") + F.col("_at")).drop("_part", "_at", "_from")


def merge_table(spark: SparkSession, path: str, update: DataFrame, key: str | list[str], at: str) -> None:
    """A Parquet table merged with an update by key; the last row by `at` holds. Replaced as `replace_table` does."""
    from veinstone.operators.ingest import upsert

    here, _, _, files = _places(spark, path)
    replace_table(spark, path, upsert(spark.read.parquet(path), update, key, at) if files.exists(here) else update)


def _places(spark: SparkSession, path: str):
    """(table, new table, old table, file system); a replacement that broke off between its renames is mended."""
    here, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".next", ".old"))
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(here) and files.exists(old):
        files.rename(old, here)
    return here, new, old, files


def replace_table(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Write a Parquet table in place of another, from which rows may come. The new version is written beside the old one, the old
    one renamed aside, the new one renamed in, and only then the old one deleted: at every moment one whole version is there."""
    here, new, old, files = _places(spark, path)
    rows.write.parquet(f"{path}.next", mode="overwrite")
    files.delete(old, True)
    if files.exists(here) and not files.rename(here, old) or not files.rename(new, here):
        raise OSError(f"{path} could not be renamed; the new rows are at {path}.next")
    files.delete(old, True)
