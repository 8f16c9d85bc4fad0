"""Readers and writers over files that are made from the tables and read back, with oracle SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import chunk, html
from veinstone.functions import text as ft
from veinstone.operators import batches, flatten, graph, ingest, rag, vector
from veinstone.plans.graph_queries import _entities, _relations
from veinstone.session import once, prepare, scratch, table
from veinstone.sources import files, sinks
from veinstone.streaming import pipelines


def _root(spark: SparkSession, name: str) -> str:
    return scratch(prepare(spark), name)


def _reports(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return once(table(spark, sf_dir, "reports", "report_id", *columns), "report_id")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents", "doc_id", *columns)


def read_report_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as year/name.txt and read back; a year that is none is left out."""
    root = _root(spark, "tree")
    rows = _reports(spark, sf_dir, "report_text", "report_year")
    sinks.write_each(rows.select(F.concat(F.coalesce(F.col("report_year").cast("string"), F.lit("none")), F.lit("/r"), F.col("report_id"), F.lit(".txt")).alias("path"), F.col("report_text").alias("text")), root)
    found = files.report_tree(spark, root)
    return found.select(F.col("year").cast("bigint").alias("year"), "name", F.md5("text").alias("text_md5"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text and JSON files and read back with one reader for all kinds."""
    root = _root(spark, "documents")
    rows = _documents(spark, sf_dir, "text").where("text is not null")
    kind = F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".JSON")
    sinks.write_each(rows.select(F.concat((F.col("doc_id") % 7).cast("string"), F.lit("/d"), F.col("doc_id"), kind).alias("path"), "text"), root)
    return files.documents(spark, root).select("source", "kind", F.md5("page_content").alias("content_md5"))


def read_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles written as JSON files, one of each source: an array, whose elements are documents."""
    root = _root(spark, "json")
    rows = _documents(spark, sf_dir, "source", "title").where("source is not null").groupBy("source").agg(F.to_json(F.array_sort(F.collect_set("title"))).alias("text"))
    sinks.write_each(rows.select(F.concat("source", F.lit(".json")).alias("path"), "text"), root)
    return files.json_documents(spark, root).select("source", F.col("seq").cast("bigint").alias("seq"), "page_content")


def read_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of files of a directory."""
    root = _root(spark, "listing")
    rows = _documents(spark, sf_dir, "text").where("text is not null")
    sinks.write_each(rows.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text"), root)
    return files.listing(spark, root).select("file", F.col("size").cast("bigint").alias("size"))


def read_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with XML written by year as files and read back, with the sections that are there."""
    root = _root(spark, "xml")
    rows = batches.parse_replies(once(table(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id")).where("xml is not null and year is not null")
    sinks.write_each(rows.select(F.concat(F.coalesce("year", F.lit("x")), F.lit("/r"), F.col("response_id"), F.lit(".xml")).alias("path"), F.col("xml").alias("text")), root)
    found = files.xml_files(spark, root)
    return found.select("name", F.md5("xml").alias("xml_md5"), F.col("xml").contains("<Entitys>").alias("entities"))


def read_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities written as one report graph a report and read back."""
    root = _root(spark, "graphs")
    rows = _entities(spark, sf_dir, "report_id", "entity_id", "entity_name", "entity_labels")
    entity = F.struct(F.col("entity_id").alias("EntityId"), F.col("entity_name").alias("EntityName"), F.col("entity_labels").alias("Labels"))
    graphs = rows.groupBy("report_id").agg(F.to_json(F.struct(F.collect_list(entity).alias("Entities"), F.array().cast("array<struct<Source: string>>").alias("Relationships"))).alias("text"))
    sinks.write_each(graphs.select(F.concat(F.lit("g"), F.col("report_id"), F.lit(".json")).alias("path"), "text"), root)
    found = files.graph_files(spark, root).select(ft.stem(F.col("path")).alias("file"), F.explode("Entities").alias("e"))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("entities"), F.count("e.EntityName").alias("named"), F.sum(F.coalesce(F.size("e.Labels"), F.lit(0))).alias("labels"))


def read_reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies written as JSON lines, every fifth cut off, and read back: broken lines are errors of their own."""
    root = _root(spark, "replies")
    rows = once(table(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id")
    line = F.to_json(F.struct("response_id", "custom_id", "response"))
    sinks.write_lines(rows.select(F.when(F.col("response_id") % 5 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")), root)
    found = files.json_lines(spark, root, "response_id bigint, " + batches.RESPONSE.replace(", _corrupt_record string", ""))
    ok = F.col("_corrupt_record").isNull()
    return found.select(F.when(ok, F.col("response_id")).alias("id"), ok.alias("ok"), F.when(ok, F.md5(batches.first_content(F.col("response")))).alias("content_md5")).groupBy("id", "ok", "content_md5").agg(F.count(F.lit(1)).alias("lines"))


def read_indicator_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator lines of all documents written as a list with a byte order mark and read back, repeats together."""
    root = _root(spark, "indicators")
    rows = _documents(spark, sf_dir, "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value")).where(F.col("value").rlike(r"^(Domain|IP|md5|sha1|sha256|URL|Email Address),[^,\s]+$"))
    sinks.write_lines(rows.select(F.concat(F.lit("﻿"), "value").alias("value")), root)
    return files.indicator_list(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("values"))


def read_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names written as one JSON array a feed and read back, each once."""
    root = _root(spark, "names")
    rows = _reports(spark, sf_dir, "feed_code", "file_path").where("file_path is not null").groupBy("feed_code").agg(F.to_json(F.collect_list("file_path")).alias("text"))
    sinks.write_each(rows.select(F.concat(F.coalesce("feed_code", F.lit("none")), F.lit(".json")).alias("path"), "text"), root)
    return files.name_list(spark, root)


def read_report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report index a feed, newest entry first."""
    root = _root(spark, "index")
    rows = _reports(spark, sf_dir, "feed_code", "report_name", "report_year").where("feed_code is not null")
    entry = F.struct(F.col("report_name").alias("Title"), F.col("report_year").cast("string").alias("Year"), F.col("report_id").cast("string").alias("Filename"))
    lists = rows.groupBy("feed_code").agg(F.sort_array(F.collect_list(F.struct("report_id", entry.alias("e")))).alias("all"))
    sinks.write_each(lists.select(F.concat("feed_code", F.lit(".json")).alias("path"), F.to_json(F.transform("all", lambda r: r["e"])).alias("text")), root)
    found = files.report_index(spark, root)
    return found.select(F.col("pos").cast("bigint").alias("pos"), F.col("Filename").alias("file"), F.col("Title").alias("title"), F.col("Year").alias("year"))


def write_graph_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report graphs written by status and year; those without entities are not kept."""
    root = _root(spark, "routed")
    rows = batches.parse_replies(once(table(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id"))
    status = F.when(F.col("content").contains("<Entity>") & F.col("content").contains("<Relationship>"), "SUCCESS").when(F.col("content").contains("<Entity>"), "MISSING_RELATIONS").otherwise("MISSING_ENTITIES")
    sinks.write_routed(rows.select("response_id", F.coalesce("year", F.lit("none")).alias("year"), status.alias("status")), root)
    return spark.read.json(root).groupBy("status").agg(F.count(F.lit(1)).alias("graphs"))


def write_reports_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written partitioned by year and read back."""
    root = _root(spark, "years")
    sinks.write_by_year(_reports(spark, sf_dir, "report_year", "report_text").withColumnRenamed("report_year", "year"), root)
    return spark.read.parquet(root).groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("reports"), F.sum(F.length("report_text")).alias("characters"))


def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of early reports merged with the later ones, twice: the later row of a key holds."""
    root = _root(spark, "merged")
    rows = _reports(spark, sf_dir, "feed_code", "ingested_at").where("ingested_at is not null and feed_code is not null")
    early = rows.where("ingested_at < timestamp'2021-01-01'").groupBy("feed_code").agg(F.max(F.struct("ingested_at", "report_id")).alias("r"))
    late = rows.where("ingested_at >= timestamp'2019-01-01'").groupBy("feed_code").agg(F.max(F.struct("ingested_at", "report_id")).alias("r"))
    for part in (early, late):
        sinks.merge_table(spark, f"{root}/t", part.select("feed_code", "r.*"), "feed_code", "ingested_at")
    return spark.read.parquet(f"{root}/t").select("feed_code", "report_id")


def flat_tables_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables of all graphs, written by tag and read back."""
    root = _root(spark, "flat")
    tagged = flatten.flatten_graphs(once(table(spark, sf_dir, "report_graphs", "graph_id", "graph_json"), "graph_id"))
    flatten.write_tables(tagged, root)
    return spark.read.parquet(root).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("parent_pk").alias("parents"), F.countDistinct("pk").alias("keys"))


def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with a number that is dense over the whole batch."""
    rows = _documents(spark, sf_dir, "text").where("text is not null").select("doc_id", F.explode(chunk.windows(F.col("text"))).alias("c")).select("doc_id", F.col("c.chunk_no").cast("bigint").alias("chunk_no"))
    return sinks.chunks_with_number(rows, ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", F.col("chunk_id").cast("bigint").alias("chunk_id"))


def content_addressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written once each under the name of their content, those without a title deleted again, and the files that are left."""
    root = _root(spark, "addressed")
    rows = _documents(spark, sf_dir, "text", "title").where("text <> ''").withColumn("path", F.concat(F.sha2("text", 256), F.lit(".txt")))
    kept = rows.groupBy("path").agg(F.first("text").alias("text"), F.max(F.col("title").isNotNull()).alias("titled"))
    sinks.write_each(kept, root)
    sinks.remove_each(kept.where("not titled"), root)
    return files.listing(spark, root).select("file", F.col("size").cast("bigint").alias("size"))


def retrieval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with all their hits in one prompt, and what the stand-in for a model answers."""
    rows = _documents(spark, sf_dir, "title", "lang")
    questions = rows.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("What of "), F.coalesce("lang", F.lit("it")), F.lit("?")).alias("question"))
    hits = rows.where("title is not null").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.lit("s").alias("source"), F.col("title").alias("content"))
    return rag.retrieval_answer(questions, hits).select("query_id", F.md5("prompt").alias("prompt_md5"), "answer")


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose file is in the list of a feed's other reports, and those still to do."""
    rows = _reports(spark, sf_dir, "file_path", "report_year").where("file_path is not null")
    done = rows.where("report_year < 2018")
    left = ingest.not_yet(rows, done, "file_path").select("report_id", F.lit("to do").alias("state"))
    return left.unionByName(rows.join(done.select("file_path").distinct(), "file_path", "left_semi").select("report_id", F.lit("known").alias("state")))


def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of uploads by content: the last name and time of each, merged from two batches."""
    rows = _documents(spark, sf_dir, "text", "title", "collected_at").where("text is not null and collected_at is not null")
    entry = rows.groupBy(F.sha2("text", 256).alias("hash"))
    first, last = entry.agg(F.min(F.struct("collected_at", "doc_id")).alias("r")), entry.agg(F.max(F.struct("collected_at", "doc_id")).alias("r"))
    merged = ingest.upsert(first.select("hash", "r.*"), last.select("hash", "r.*"), "hash", "collected_at")
    return merged.select("hash", "doc_id", ft.iso(F.col("collected_at")).alias("uploaded"), ft.stamp(F.col("collected_at")).alias("stamp"))


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of reports and documents as one table."""
    rows = _reports(spark, sf_dir, "report_text").select(F.lit("report").alias("kind"), F.col("report_text").alias("text")).unionByName(_documents(spark, sf_dir, "text").select(F.lit("document").alias("kind"), "text"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, extensions, years, safe keys and titles of report files."""
    rows = _reports(spark, sf_dir, "file_path", "report_name")
    path = F.col("file_path")
    return rows.select(
        "report_id", ft.base_name(path).alias("base"), ft.stem(path).alias("stem"), ft.extension(path).alias("extension"), ft.scan_year(path).alias("scan_year"),
        ft.safe_key(F.col("report_name")).alias("key"), ft.document_title(F.col("report_name"), path).alias("title"), ft.is_web(path).alias("web"),
    )


def agent_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent is given, as text, as an object, as broken JSON."""
    rows = _documents(spark, sf_dir, "title")
    form = F.col("doc_id") % 4
    given = F.when(form == 0, F.col("title")).when(form == 1, F.to_json(F.struct(F.col("title").alias("input")))).when(form == 2, F.to_json(F.struct(F.lit(1).alias("other")))).otherwise(F.concat(F.lit('{"input": "'), "title"))
    return rows.select("doc_id", ft.agent_input(given).alias("input"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the anchors of pages made from documents' lines."""
    rows = _documents(spark, sf_dir, "text").where("text is not null")
    page = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('<p><a class="x" href="/at?d='), F.md5(x), F.lit('&amp;n=1">go</a><a name="y">no</a></p>'))), "\n")
    return rows.select("doc_id", F.posexplode(html.links(page)).alias("pos", "target")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "target")


def html_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of pages whose text nodes stand in nested elements: each node is stripped, blank ones fall out, one space joins."""
    rows = _documents(spark, sf_dir, "title", "lang")
    part = lambda c: F.coalesce(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    page = F.concat(F.lit("<html><body><div> <p>\n"), part("title"), F.lit(" </p>\n<style>x</style><b>"), part("lang"), F.lit("</b>tail</div></body></html>"))
    return rows.select("doc_id", html.page(page)["content"].alias("content"))


def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the questions that retrieve; the others have an empty one."""
    rows = _documents(spark, sf_dir, "title", "text")
    questions = rows.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 3 > 0).alias("use_rag"))
    hits = rows.where("title is not null").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.col("title").alias("source"), F.left("text", F.lit(20)).alias("content"))
    return rag.gated_context(questions, hits).select("query_id", F.md5("context").alias("context_md5"), F.col("documents").cast("bigint").alias("documents"))


def arms_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms of retrieval over the same queries side by side: exact inner product and cosine, by the best score."""
    base = table(prepare(spark), sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = base.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    second = lambda metric: vector.top_k(queries, base, 2, metric).where("rank = 2").select("query_id", F.round("score", 5).alias("score"))
    return rag.compare_arms(second("ip"), second("l2")).withColumn("gain", F.round("gain", 4))


def graph_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clearing of the graph would remove, and what is left with and without confirmation."""
    entities, relations = _entities(spark, sf_dir), _relations(spark, sf_dir)
    nodes = graph.merge_nodes(entities)
    edges = graph.merge_edges(nodes.select("label", "name"), relations)
    row = graph.clear_statistics(nodes, edges)
    kept, gone = graph.clear_graph(nodes, edges)[0].count(), graph.clear_graph(nodes, edges, True)[0].count()
    bare = graph.clear_properties(nodes).where("id is not null or labels is not null").count()
    return row.select("nodes", "edges", "labels", "keys", F.lit(kept).cast("bigint").alias("kept"), F.lit(gone).cast("bigint").alias("left"), F.lit(bare).cast("bigint").alias("filled"))


def fixes_by_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected relations by report and year, as the correction counts them."""
    from veinstone.plans.graph_queries import _checked

    years = _reports(spark, sf_dir, "report_year")
    fixed = _checked(spark, sf_dir).groupBy("report_id").agg(F.count_if(F.col("status") == "fixed").alias("fixed"), F.count(F.lit(1)).alias("relations"))
    return fixed.join(years, "report_id", "left").select("report_id", F.col("report_year").cast("bigint").alias("year"), "fixed", "relations")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and reciprocal rank of five neighbours by cosine against the five by inner product at least 0.35."""
    base = table(prepare(spark), sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = base.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector.evaluate(vector.top_k(queries, base, 5, "cosine"), vector.top_k(queries, base, 5, "ip", 0.35), 5)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event windows computed as a stream with a watermark to the end of a bounded input, as update after update kept by key."""
    root = _root(spark, "windows")
    events = table(prepare(spark), sf_dir, "events", "ts", "event_type", "value")
    events.write.parquet(f"{root}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(f"{root}/in")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out")

    query = pipelines.windows(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    last = out.groupBy("start", "end", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select("start", "end", "event_type", "r.n", "r.total")


QUERIES = {
    f.__name__: f
    for f in (
        read_report_tree, read_documents, read_json_documents, read_listing, read_xml_files, read_graph_files, read_reply_lines, read_indicator_list, read_name_list, read_report_index,
        write_graph_routed, write_reports_by_year, merge_reports, flat_tables_written, chunk_numbers, content_addressed_files, retrieval_prompts, known_files, upload_manifest, merge_union, text_forms, agent_inputs, html_links, html_join,
        retrieval_gate, arms_compared, graph_cleared, fixes_by_report, retrieval_metrics, stream_windows,
    )
}

from veinstone.plans.graph_queries import _CAP, _CHECKED, _ENT, _REL, _REPLY  # noqa: E402
from veinstone.plans.text_queries import _NEAR, _RSP, _SCORE, _WINDOW  # noqa: E402

_RPT = "rpt AS (SELECT DISTINCT ON (report_id) * FROM reports)"
_L2 = f"2 * {_SCORE} - list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) - list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_BASE = "CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[-1] ELSE file_path END"
ORACLES = {
    "read_report_tree": f"WITH {_RPT} SELECT CAST(report_year AS BIGINT) AS year, 'r' || report_id AS name, md5(coalesce(report_text, '')) AS text_md5 FROM rpt WHERE report_year IS NOT NULL AND report_text <> ''",
    "read_documents": "SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.JSON' END AS source, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.json' END AS kind, md5(text) AS content_md5 FROM documents WHERE text <> ''",
    "read_json_documents": "WITH t AS (SELECT DISTINCT source, title FROM documents WHERE source IS NOT NULL AND title IS NOT NULL) SELECT source || '.json' AS source, row_number() OVER (PARTITION BY source ORDER BY title) - 1 AS seq, title AS page_content FROM t",
    "read_listing": "SELECT 'd' || doc_id || '.txt' AS file, strlen(text) AS size FROM documents WHERE text <> ''",
    "read_xml_files": f"""WITH {_REPLY}, ids AS (SELECT DISTINCT ON (response_id) response_id, custom_id FROM batch_responses),
  x AS (SELECT response_id, CASE WHEN e <> '' OR r <> '' THEN (CASE WHEN e <> '' THEN e || chr(10) ELSE '' END) || r WHEN f <> '' THEN f ELSE content END AS xml FROM cut JOIN ids USING (response_id) WHERE len(string_split(custom_id, '_')) >= 2)
  SELECT 'r' || response_id AS name, md5(xml) AS xml_md5, contains(xml, '<Entitys>') AS entities FROM x WHERE xml <> ''""",
    "read_graph_files": f"WITH {_ENT} SELECT 'g' || report_id AS file, count(*) AS entities, count(entity_name) AS named, CAST(sum(coalesce(len(entity_labels), 0)) AS BIGINT) AS labels FROM ent GROUP BY report_id",
    "read_reply_lines": f"WITH {_RSP}, l AS (SELECT response_id % 5 <> 0 AS ok, response_id, content FROM rsp) SELECT CASE WHEN ok THEN response_id END AS id, ok, CASE WHEN ok THEN md5(content) END AS content_md5, count(*) AS lines FROM l GROUP BY ALL",
    "read_indicator_list": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT regexp_extract(value, '^(Domain|IP|md5|sha1|sha256|URL|Email Address),([^,\\s]+)$', ['kind', 'item']) AS r FROM l) SELECT r.kind AS kind, count(*) AS values FROM p WHERE r.kind <> '' GROUP BY ALL",
    "read_name_list": f"WITH {_RPT} SELECT DISTINCT file_path AS file FROM rpt WHERE file_path IS NOT NULL",
    "read_report_index": f"WITH {_RPT} SELECT row_number() OVER (PARTITION BY feed_code ORDER BY report_id) - 1 AS pos, CAST(report_id AS VARCHAR) AS file, report_name AS title, CAST(report_year AS VARCHAR) AS year FROM rpt WHERE feed_code IS NOT NULL",
    "write_graph_routed": f"WITH {_REPLY} SELECT CASE WHEN contains(content, '<Relationship>') THEN 'SUCCESS' ELSE 'MISSING_RELATIONS' END AS status, count(*) AS graphs FROM rep WHERE contains(content, '<Entity>') GROUP BY ALL",
    "write_reports_by_year": f"WITH {_RPT} SELECT CAST(report_year AS BIGINT) AS year, count(*) AS reports, CAST(sum(length(report_text)) AS BIGINT) AS characters FROM rpt GROUP BY ALL",
    "merge_reports": f"WITH {_RPT}, r AS (SELECT * FROM rpt WHERE ingested_at IS NOT NULL AND feed_code IS NOT NULL) SELECT DISTINCT ON (feed_code) feed_code, report_id FROM r ORDER BY feed_code, ingested_at DESC, report_id DESC",
    "chunk_numbers": """WITH d AS (SELECT doc_id, greatest(1, CAST(ceil((length(text) - 1000) / 2000.0) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(range(n)) AS chunk_no FROM d)
  SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS chunk_id FROM c""",
    "content_addressed_files": "SELECT sha256(text) || '.txt' AS file, CAST(min(strlen(text)) AS BIGINT) AS size FROM documents WHERE text <> '' GROUP BY text HAVING count(title) > 0",
    "retrieval_prompts": f"""WITH c AS (SELECT doc_id, title, coalesce(lang, 'it') AS lang, CASE WHEN title IS NULL THEN '{rag.NONE}' ELSE '{rag.HEADER.replace(chr(10), "' || chr(10) || '")}' || '[文档1] 来源: s' || chr(10) || '内容: ' || title || chr(10) || chr(10) END AS context FROM documents)
  SELECT doc_id AS query_id, md5('History:' || chr(10) || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: What of ' || lang || '?' || chr(10) || 'Answer:') AS prompt_md5, CASE WHEN title IS NULL THEN '{rag.NONE}' ELSE '内容: ' || title END AS answer FROM c""",
    "known_files": f"WITH {_RPT} SELECT report_id, CASE WHEN file_path IN (SELECT file_path FROM rpt WHERE report_year < 2018 AND file_path IS NOT NULL) THEN 'known' ELSE 'to do' END AS state FROM rpt WHERE file_path IS NOT NULL",
    "upload_manifest": "SELECT DISTINCT ON (text) sha256(text) AS hash, doc_id, regexp_replace(strftime(collected_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS uploaded, strftime(collected_at, '%Y%m%d_%H%M%S') AS stamp FROM documents WHERE text IS NOT NULL AND collected_at IS NOT NULL ORDER BY text, collected_at DESC, doc_id DESC",
    "merge_union": f"WITH {_RPT}, u AS (SELECT 'report' AS kind, report_text AS text FROM rpt UNION ALL SELECT 'document', text FROM documents) SELECT kind, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters FROM u GROUP BY ALL",
    "text_forms": f"""WITH {_RPT}, b AS (SELECT *, {_BASE} AS base FROM rpt), s AS (SELECT *, regexp_replace(base, '\\.[^.]*$', '') AS stem FROM b)
  SELECT report_id, base, stem, lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) AS extension, CASE WHEN file_path IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_extract(file_path, '(^|/)(20[0-9]{{2}})/[^/]*$', 2), ''), nullif(regexp_extract(base, '(20[0-9]{{2}})', 1), ''), 'unknown') END AS scan_year,
  CASE WHEN regexp_matches(report_name, '[ .-]') THEN '`' || report_name || '`' ELSE report_name END AS key, coalesce(nullif(trim(report_name, ' '), ''), stem) AS title, coalesce(starts_with(file_path, 'http'), false) AS web FROM s""",
    "agent_inputs": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN title WHEN 1 THEN coalesce(title, '{}') WHEN 2 THEN '{"other":1}' ELSE '{"input": "' || title END AS input FROM documents""",
    "html_links": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM l) SELECT doc_id, pos, '/at?d=' || md5(line) || '&n=1' AS target FROM u",
    "html_join": "SELECT doc_id, array_to_string(list_filter([trim(coalesce(title, ''), ' '), trim(coalesce(lang, ''), ' '), 'tail'], lambda x: x <> ''), ' ') AS content FROM documents",
    "retrieval_gate": f"""SELECT doc_id AS query_id, md5(CASE WHEN doc_id % 3 = 0 THEN '' WHEN title IS NULL THEN '{rag.NONE}' ELSE '{rag.HEADER.replace(chr(10), "' || chr(10) || '")}' || '[文档1] 来源: ' || title || chr(10) || '内容: ' || coalesce(left(text, 20), '') || chr(10) || chr(10) END) AS context_md5,
  CAST(CASE WHEN doc_id % 3 > 0 AND title IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS documents FROM documents""",
    "arms_compared": f"WITH a AS ({_NEAR.format(score=_SCORE, where='')} SELECT query_id, round(score, 5) AS s FROM r WHERE rank = 2), b AS ({_NEAR.format(score=_L2, where='')} SELECT query_id, round(score, 5) AS s FROM r WHERE rank = 2) SELECT query_id, a.s AS text_only, b.s AS graph_enhanced, round(b.s - a.s, 4) AS gain FROM a FULL JOIN b USING (query_id)",
    "graph_cleared": f"""WITH {_ENT}, {_REL}, n AS (SELECT DISTINCT {_CAP} AS label, entity_name AS name FROM ent WHERE entity_id IS NOT NULL AND entity_name IS NOT NULL AND entity_type IS NOT NULL),
  e AS (SELECT DISTINCT a.label AS sl, r.source_name, upper(r.relationship_type) AS type, b.label AS tl, r.target_name FROM rel r JOIN n a ON a.name = r.source_name JOIN n b ON b.name = r.target_name WHERE relationship_id IS NOT NULL AND relationship_type IS NOT NULL)
  SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM n) AS labels, 'id,subtype,properties,labels,variant_names,times' AS keys, (SELECT count(*) FROM n) AS kept, CAST(0 AS BIGINT) AS "left", CAST(0 AS BIGINT) AS filled""",
    "fixes_by_report": f"{_CHECKED}, {_RPT} SELECT c.report_id, CAST(any_value(rpt.report_year) AS BIGINT) AS year, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) AS relations FROM checked c LEFT JOIN rpt ON rpt.report_id = c.report_id GROUP BY c.report_id",
    "retrieval_metrics": f"""WITH f AS ({_NEAR.format(score="list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])", where='')} SELECT query_id, id, rank FROM r WHERE rank <= 5), t AS ({_NEAR.format(score=_SCORE, where='WHERE score >= 0.35')} SELECT query_id, id FROM r WHERE rank <= 5),
  h AS (SELECT f.query_id, count(t.id) AS hits, count(*) AS shown, min(CASE WHEN t.id IS NOT NULL THEN rank END) AS first FROM f LEFT JOIN t USING (query_id, id) GROUP BY ALL), w AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY ALL)
  SELECT count(*) AS queries, round(avg(coalesce(hits, 0) / wanted), 6) AS recall, round(avg(coalesce(hits / nullif(shown, 0), 0.0)), 6) AS precision, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM w LEFT JOIN h USING (query_id)""",
    "stream_windows": _WINDOW.format(start="date_trunc('hour', ts)", source="events"),
}
