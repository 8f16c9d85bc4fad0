"""Queries of the llm problems over the driver's tables, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import collapse, encode, names, pack, pairs, residue, scans, split
from veinstone.session import checked_broadcast, once, prepare, stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of request and response with its defect."""
    prepare(spark)
    requests = table(spark, sf_dir, "batch_requests", "custom_id", "body")
    return pairs.broken_pairs(requests, table(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of mentions that stand for one person or organisation."""
    prepare(spark)
    return names.same_pairs(_classed(spark, sf_dir)).toDF("mention_a", "mention_b")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention with the least mention of its class."""
    prepare(spark)
    classed = _classed(spark, sf_dir)
    heads = classed.groupBy("class").agg(F.min("mention_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    return names.join_hot(classed, heads, "class", "_n").select("mention_id", "class_id")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "entities", "mention_id", "entity_name", "entity_variant_names", "entity_sub_type").where(F.col("entity_sub_type").isin("user", "org"))
    return names.link_names(once(mentions, "mention_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line kept with each other line alike."""
    prepare(spark)
    _, members = collapse.collapse(table(spark, sf_dir, "entity_lines", "line_id", "raw_entity"))
    return members.where("line_id <> kept").select(F.col("kept").alias("kept_line"), F.col("line_id").alias("copy_line"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set alike with the number of its copies."""
    prepare(spark)
    classes, _ = collapse.collapse(table(spark, sf_dir, "entity_lines", "line_id", "raw_entity"))
    return classes


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    reports = once(table(spark, sf_dir, "reports", "report_id", "report_text", "report_name", "feed_code").where("report_text is not null"), "report_id")
    return reports.join(checked_broadcast(table(spark, sf_dir, "feeds", "feed_code", "feed_title").dropDuplicates(["feed_code"])), "feed_code", "left")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of scanned pages by line."""
    noise = scans.scan_noise(_reports(spark, sf_dir))
    return noise.select(F.col("key").alias("report_id"), (F.col("line") + 1).cast("bigint").alias("line_no"), "noise", "word").distinct()


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All report texts, the scanned ones as continuous paragraphs."""
    return scans.repair_scans(_reports(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report cut into more than one piece, forced if any of its cuts found no boundary."""
    prepare(spark)
    long = table(spark, sf_dir, "reports", "report_id", "report_text").where(F.length("report_text") > 3000)  # shorter ones have no cut; repeats fall together below
    cuts = split.split_texts(long, "report_id", "report_text", 3000, 1000, False).where("cut <> 'end'")
    forced = F.max(F.when(F.col("cut") == "forced", "forced").otherwise("boundary"))
    return cuts.groupBy("report_id").agg(forced.alias("cut"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all reports with their texts."""
    prepare(spark)
    reports = once(table(spark, sf_dir, "reports", "report_id", "report_text").where("report_text is not null"), "report_id")
    return split.split_texts(reports, "report_id", "report_text", 3000, 1000, True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    prepare(spark)
    return encode.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's containers of 2,048 tokens."""
    prepare(spark)
    sizes = stored(encode.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text")), "sizes")
    return pack.pack(sizes, "doc_id", "tokens", 2048)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, against the least number that could hold the tokens."""
    by = p9_pack(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    least = F.ceil(F.sum("used") / 2048).alias("least_containers")
    return by.agg(F.count(F.lit(1)).alias("containers"), least, F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("pieces").alias("pieces"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are residue, with its kind."""
    prepare(spark)
    return residue.template_residue(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without residue."""
    found = p10_found(spark, sf_dir)
    return table(spark, sf_dir, "documents").join(found, "doc_id", "left_anti")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_classes": p3_classes, "p5_found": p5_found, "p5_text": p5_text, "p6_found": p6_found, "p6_pieces": p6_pieces, "p8_ids": p8_ids, "p9_pack": p9_pack, "p9_fill": p9_fill, "p10_found": p10_found, "p10_kept": p10_kept}
_SPLIT = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}。！？；，]"
ORACLES = {
    "p6_found": f"""WITH r AS (SELECT DISTINCT ON (report_id) report_id, report_text AS t FROM reports WHERE length(report_text) > 3000)
  SELECT report_id, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '{_SPLIT}'), lambda x: length(x))) > 3000 THEN 'forced' ELSE 'boundary' END AS cut FROM r""",
}
