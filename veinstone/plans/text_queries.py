"""Text, batch, retrieval, ingestion and streaming queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import chunk, html
from veinstone.functions import text as ft
from veinstone.operators import batches, extraction, ingest, rag, vector
from veinstone.session import checked_broadcast, once, prepare, scratch, table
from veinstone.sources import files
from veinstone.streaming import pipelines

TEMPLATE = "Extract the entities and relations of this report:\n{input}"


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, name, *columns)


def _reports(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return once(_t(spark, sf_dir, "reports", "report_id", *columns), "report_id")


def batch_request_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for all reports with text, read back from their JSON lines."""
    rows = _reports(spark, sf_dir, "report_text", "report_name", "report_year").where("trim(report_text) <> ''")
    key = ft.custom_id(F.coalesce("report_year", F.lit(0)), F.coalesce("report_name", F.lit("")), F.col("report_id"))
    lines = rows.select(batches.request_line(key, "You extract.", TEMPLATE, F.col("report_text"), "any").alias("value"))
    r = F.from_json("value", batches.REQUEST)
    return lines.select(r.alias("r")).select("r.custom_id", "r.method", F.md5(F.col("r.body.messages")[1]["content"]).alias("content_md5"), F.col("r.body.max_tokens").cast("bigint").alias("max_tokens"))


def batch_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid request lines: the requests as lines, those without system message with a key missing."""
    requests = once(_t(spark, sf_dir, "batch_requests", "custom_id", "http_method", "url", "body"), "custom_id")
    system = F.get(F.filter("body.messages", lambda m: m["role"] == "system"), F.lit(0))["content"]
    line = F.to_json(F.struct("custom_id", F.when(system.isNotNull(), F.col("http_method")).alias("method"), "url", "body"))
    return batches.line_counts(requests.select(line.alias("value")))


def batch_result_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by status and year of their id."""
    rows = batches.parse_replies(once(_t(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id"))
    return rows.groupBy("status", "year").agg(F.count(F.lit(1)).alias("replies"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the batch went: replies in all, succeeded, failed, rate."""
    return batches.run_stats(batches.parse_replies(once(_t(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id")))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = once(_t(spark, sf_dir, "batch_requests", "custom_id", "body"), "custom_id")
    return requests.select("custom_id", F.posexplode("body.messages").alias("pos", "m")).select("custom_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def user_message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages wrapped in each of the forms a client sends, and the question read back."""
    rows = _messages(spark, sf_dir).where("role = 'user'")
    wrap = lambda *cols: F.to_json(F.struct(*cols))
    inner = F.struct(F.col("content").alias("action_input"))
    form = F.length("content") % 6
    message = (
        F.when(form == 0, F.col("content")).when(form == 1, wrap(F.lit("ask").alias("action"), F.col("content").alias("action_input")))
        .when(form == 2, wrap(inner.alias("data"))).when(form == 3, wrap(F.col("content").alias("data"))).when(form == 4, wrap(F.lit(1).alias("other"))).otherwise(F.concat(F.lit('{"action": "ask", "action_input": '), "content"))
    )
    return rows.select("custom_id", F.md5(ft.user_question(message)).alias("question_md5"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _messages(spark, sf_dir).select(F.col("custom_id").alias("conv_id"), F.col("pos").cast("bigint").alias("turn"), "role", F.col("content").alias("text"))
    replies = once(_t(spark, sf_dir, "batch_responses", "response_id", "custom_id", "response"), "response_id").where("custom_id is not null")
    said = replies.select(F.col("custom_id").alias("conv_id"), (F.col("response_id") + 1000).alias("turn"), F.lit("assistant").alias("role"), batches.first_content(F.col("response")).alias("text"))
    return asked.unionByName(said)


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turns before it."""
    return rag.history(_turns(spark, sf_dir)).select("conv_id", "turn", F.md5("history").alias("history_md5"))


def conversation_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from replies, half of them wrapped as JSON; blank ones fall back to the conversation's id."""
    rows = _turns(spark, sf_dir).where("role = 'assistant'")
    reply = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("title")))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.md5(ft.title_of(reply, F.col("conv_id"))).alias("title_md5"))


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of frames of each reply's event stream and a digest of its token frames."""
    rows = _turns(spark, sf_dir).where("role = 'assistant' and text is not null")
    made = rag.frames(F.col("conv_id"), F.lit("[]"), F.split("text", " "), F.lit("t"))
    tokens = F.filter(made, lambda f: f.startswith("data: ") & ~f.startswith("data: [rag"))
    return rows.select("conv_id", "turn", F.size(made).cast("bigint").alias("frames"), F.md5(F.array_join(tokens, "")).alias("tokens_md5"))


def token_stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together from their tokens."""
    rows = _turns(spark, sf_dir).where("role = 'assistant' and text is not null")
    tokens = rows.select(F.concat_ws("#", "conv_id", "turn").alias("conv_id"), F.posexplode(F.split("text", "")).alias("seq", "token"))
    return pipelines.token_answers(tokens).select("conv_id", F.md5("answer").alias("answer_md5"))


def session_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation ids given or, where a reply has none, made from its key."""
    rows = once(_t(spark, sf_dir, "batch_responses", "response_id", "custom_id"), "response_id").withColumn("made", F.md5(F.col("response_id").cast("string")))
    return rows.select("response_id", pipelines.ensure_conversation("custom_id", "made").alias("conv_id"))


def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files that are new or gone: those ingested by the end of 2020 are known, those published since 2019 are there."""
    rows = _reports(spark, sf_dir, "file_path", "ingested_at", "published_at").where("file_path is not null").withColumnRenamed("file_path", "file")
    return ingest.manifest_delta(rows.where("published_at >= timestamp'2019-01-01'"), rows.where("ingested_at < timestamp'2021-01-01'"))


def content_addressed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document texts by their SHA-256."""
    return ingest.content_addressed(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text has the expected SHA-1; documents without a title are given a wrong one."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "text", "title").where("text is not null")
    rows = rows.withColumn("expected", F.when(F.col("title").isNull(), F.lit("0")).otherwise(F.upper(F.sha1("text"))))
    return ingest.verify(rows, "text", "expected").groupBy("ok").agg(F.count(F.lit(1)).alias("documents"))


def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 3,000 characters."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(chunk.windows(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.chunk_no").cast("bigint").alias("chunk_no"), F.length("c.content").cast("bigint").alias("size"), F.md5("c.content").alias("content_md5"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 3,000 characters at the coarsest separators that fit."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(chunk.recursive()("text")).alias("chunk_no", "content"))
    return rows.select("doc_id", "chunk_no", F.length("content").alias("size"), F.md5("content").alias("content_md5"))


def html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and content of pages made from documents, read back."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "text", "title").where("text is not null")
    from veinstone.operators.xmlparse import escaped

    body = F.array_join(F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p> "), escaped(p), F.lit("</p>\n"))), "")
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit("<title>"), escaped(F.col("title")), F.lit("</title>"))).otherwise("")
    page = F.concat(F.lit("<html><head>"), title, F.lit("<style>p {color: red}</style><script>if (a < b) {c()}</script></head><body>"), body, F.lit("</body></html>"))
    return rows.select("doc_id", html.page(page).alias("p")).select("doc_id", F.col("p.title").alias("title"), F.md5(F.regexp_replace("p.content", "[\\s\u00a0]+", "")).alias("content_md5"))


def ioc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators in all documents: occurrences and distinct values by kind."""
    rows = _t(spark, sf_dir, "documents", "text").where("text is not null").select(F.explode(ft.indicators(F.col("text"))).alias("i"))
    return rows.groupBy("i.kind").agg(F.count(F.lit(1)).alias("found"), F.countDistinct("i.value").alias("values"))


def kv_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value lines of all documents by namespace and key."""
    rows = _t(spark, sf_dir, "documents", "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))
    return files.key_values(rows).where("ns is not null").groupBy("ns", "key").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("item").alias("values"))


def sensor_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor events in all documents by protocol and action."""
    rows = _t(spark, sf_dir, "documents", "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value")).where(F.col("value").startswith('{"time"'))
    events = rows.select(F.from_json("value", "time double, src string, protocol string, action string, dport int").alias("e")).select("e.*").where("time is not null")
    return events.groupBy("protocol", "action").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("src").alias("sources"), F.round(F.min("time"), 3).alias("first"), F.max("dport").cast("bigint").alias("max_port"))


def ioc_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column indicator lines of all documents by kind."""
    rows = _t(spark, sf_dir, "documents", "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))
    part = lambda n: F.regexp_extract("value", r"^(Domain|IP|md5|sha1|sha256|URL|Email Address),(\S+)$", n)
    return rows.select(part(1).alias("kind"), part(2).alias("item")).where("kind <> ''").groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("item").alias("values"))


def year_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and their characters by the year of their name, else of their path."""
    rows = _reports(spark, sf_dir, "report_name", "file_path", "report_text")
    year = ft.report_year(F.col("report_name"), F.col("file_path")).cast("bigint")
    return rows.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("reports"), F.sum(F.length("report_text")).alias("characters"))


def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that need recognition, by their first three pages of 400 characters, and whether their text is long enough."""
    rows = _reports(spark, sf_dir, "report_text")
    n = F.greatest(F.lit(1), F.ceil(F.length("report_text") / 400).cast("int"))
    pages = F.when(F.col("report_text").isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("report_text", i * 400 + 1, F.lit(400))))
    state = F.when(F.length(F.trim("report_text")) > 100, "SUCCESS").otherwise("WARNING")
    return rows.select(ft.needs_ocr(pages).alias("needs_ocr"), state.alias("state")).groupBy("needs_ocr", "state").agg(F.count(F.lit(1)).alias("reports"))


def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the stand-in model extracts from all reports, by type and sub type."""
    rows = extraction.extract(_reports(spark, sf_dir, "report_text"), TEMPLATE, "report_text")
    # explode would add a filter on its input and so a second copy of the whole parse below it; explode_outer doesn't.
    found = rows.select("report_id", F.explode_outer("graph.Entities").alias("e")).where("e is not null")
    return found.groupBy(F.col("e.EntityType").alias("entity_type"), F.col("e.EntitySubType").alias("sub_type")).agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("report_id").alias("reports"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "embeddings", "vec_id", "embedding")
    base = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return base.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), base


def _knn(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    queries, base = _vectors(spark, sf_dir)
    return vector.top_k(queries, base, 5, metric).select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest inner product with each query vector."""
    return _knn(spark, sf_dir, "ip")


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query vector."""
    return _knn(spark, sf_dir, "l2")


def knn_cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest cosine with each query vector, at least 0.3."""
    queries, base = _vectors(spark, sf_dir)
    return vector.top_k(queries, base, 5, "cosine", 0.3).select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search in inverted lists, for the same queries."""
    queries, base = _vectors(spark, sf_dir)
    index, centroids = vector.load_or_build(base, scratch(spark, "index"))
    return vector.search_lists(queries, index, centroids, 5, vector.fit_probe(base, index, centroids))


def knn_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact result the inverted lists find."""
    queries, base = _vectors(spark, sf_dir)
    return vector.evaluate(knn_ivf(spark, sf_dir), vector.top_k(queries, base, 5), 5)


def knn_ivf_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted lists find nine tenths of the exact result."""
    return knn_ivf_recall(spark, sf_dir).select("queries", (F.col("recall") >= 0.9).alias("enough"))


def chunk_recursive_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents' recursive chunks, those too long, and those that are not in their text as they are."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    rows = rows.select("doc_id", "text", F.explode_outer(chunk.recursive()("text")).alias("c"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(F.countDistinct("doc_id").alias("documents"), count(F.length("c") > 3000).alias("too_long"), count(~F.col("text").contains(F.col("c"))).alias("altered"), count(F.trim("c") == "").alias("blank"))


def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and length of the hashed embedding of every title: one, or zero without a word."""
    rows = _t(spark, sf_dir, "documents", "doc_id", "title").where("title is not null").withColumn("v", vector.embed(F.col("title")))
    return rows.select("doc_id", F.size("v").cast("bigint").alias("size"), F.round(F.sqrt(vector.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five diverse vectors of each query's twenty nearest."""
    queries, base = _vectors(spark, sf_dir)
    return vector.retrieve(queries, base, 5, 20, None).withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 5))


def mmr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of neighbours with a score of 0.4 at least."""
    queries, base = _vectors(spark, sf_dir)
    return vector.retrieve(queries, base, 5, 20, 0.4).withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 5))


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context block of each query vector: its nearest vectors' documents."""
    queries, base = _vectors(spark, sf_dir)
    docs = _t(spark, sf_dir, "documents", "doc_id", "text", "title")
    hits = vector.top_k(queries, base, 5).join(docs, F.col("id") == F.col("doc_id"), "left")
    blocks = rag.context(hits.select("query_id", "rank", F.col("title").alias("source"), F.col("text").alias("content")), queries)
    return blocks.select("query_id", F.md5("context").alias("context_md5"), F.col("documents").cast("bigint").alias("documents"))


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the nearest neighbours by label, query by query averaged."""
    labels = _t(spark, sf_dir, "embeddings", "vec_id", "label")
    queries, base = _vectors(spark, sf_dir)
    found = vector.top_k(queries, base, 6).where("query_id <> id")
    of = lambda c: checked_broadcast(labels).withColumnsRenamed({"vec_id": c, "label": f"{c}_label"})
    rows = found.join(of("query_id"), "query_id").join(of("id"), "id")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("query_id_label") == F.col("id_label")).alias("same_label"))


def dict_or_list_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lists written as arrays or as objects with the array inside, read back alike."""
    rows = once(_t(spark, sf_dir, "entities", "mention_id", "entity_labels"), "mention_id").where("entity_labels is not null")
    value = F.when(F.size("entity_labels") % 2 == 0, F.to_json("entity_labels")).otherwise(F.to_json(F.struct(F.col("entity_labels").alias("Labels"))))
    return rows.select("mention_id", F.array_join(ft.dict_or_list(value, "Labels"), ",").alias("labels"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return pipelines.windows(_t(spark, sf_dir, "events", "ts", "event_type", "value"), "tumbling")


def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sliding hour and type."""
    return pipelines.windows(_t(spark, sf_dir, "events", "ts", "event_type", "value"), "sliding")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events at most 30 minutes apart."""
    return pipelines.windows(_t(spark, sf_dir, "events", "ts", "user_id", "value"), "session")


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested as a stream of files into a chunk table."""
    prepare(spark)
    root = scratch(spark, "ingest")
    schema = ", ".join(f"{n} {t}" for n, t in spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes)
    query = pipelines.ingest(spark, f"{sf_dir}/documents.parquet*", f"{root}/chunks", f"{root}/state", schema, "doc_id", "text")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (
        batch_request_jsonl, batch_request_validation, batch_result_parse, run_stats, user_message_parse, chat_history, conversation_title, sse_frames, token_stream_concat, session_get_or_create,
        manifest_delta, content_addressed_dedup, integrity_check, chunk_fixed_window, chunk_recursive, html_content, ioc_extract, kv_line_parse, sensor_log_rollup, ioc_list_scan, year_stats, ocr_routing, entity_extraction,
        knn_ip, knn_l2, knn_cosine_threshold, knn_ivf, knn_ivf_recall, knn_ivf_enough, chunk_recursive_sound, text_embedding, mmr, mmr_threshold, rag_context, retrieval_eval, dict_or_list_normalise, event_windows, event_windows_sliding, event_sessions, ingest_stream,
    )
}

_REQ = "req AS (SELECT DISTINCT ON (custom_id) * FROM batch_requests)"
_RSP = "rsp AS (SELECT DISTINCT ON (response_id) *, coalesce(response.body.choices[1].message.content, response.choices[1].message.content) AS content FROM batch_responses)"
_RPT = "rpt AS (SELECT DISTINCT ON (report_id) * FROM reports)"
_MSG = f"{_REQ}, msg AS (SELECT custom_id, unnest(range(len(body.messages))) AS pos, unnest(body.messages) AS m FROM req)"
_TURN = f"{_MSG}, {_RSP}, turn AS (SELECT custom_id AS conv_id, pos AS turn, m.role AS role, m.content AS text FROM msg UNION ALL SELECT custom_id, response_id + 1000, 'assistant', content FROM rsp WHERE custom_id IS NOT NULL)"
_STATUS = f"""{_RSP}, st AS (SELECT *, CASE WHEN len(string_split(custom_id, '_')) >= 2 THEN string_split(custom_id, '_')[1] END AS year,
  CASE WHEN response.body.choices IS NULL AND response.choices IS NULL OR coalesce(len(response.body.choices), 0) + coalesce(len(response.choices), 0) = 0 THEN 'NO_CHOICES' WHEN coalesce(trim(content, ' '), '') = '' THEN 'EMPTY' ELSE '' END AS s0 FROM rsp),
 fin AS (SELECT *, CASE WHEN s0 <> '' THEN s0 WHEN year IS NULL THEN 'BAD_ID' ELSE 'SUCCESS' END AS status FROM st)"""
_SCORE = "CAST(list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS DOUBLE)"
_NEAR = "WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {score} AS score FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s {where})"
_LINES = "l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL)"
_IOC = " UNION ALL ".join(f"SELECT '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents WHERE text IS NOT NULL" for kind, pattern in ft.INDICATORS.items())
_FOUND = " UNION ALL ".join(f"SELECT report_id, '{kind}' AS kind, unnest(regexp_extract_all(report_text, '{pattern}')) AS value FROM rpt WHERE report_text IS NOT NULL" for kind, pattern in ft.INDICATORS.items())
_WINDOW = "SELECT {start} AS start, {start} + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM {source} GROUP BY ALL"



def _mmr(least: str) -> str:
    """Five picks of the twenty nearest, one after the other."""
    steps = [f"{_NEAR.format(score=_SCORE, where='')}, near AS (SELECT query_id, id, score FROM r WHERE rank <= 20 {least})"]
    for n in range(1, 6):
        gain = "score" if n == 1 else f"0.5 * score - 0.5 * (SELECT max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FROM ({' UNION ALL '.join(f'SELECT * FROM p{m}' for m in range(1, n))}) p JOIN embeddings a ON a.vec_id = p.id, embeddings b WHERE p.query_id = near.query_id AND b.vec_id = near.id)"
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{m} p WHERE p.query_id = near.query_id AND p.id = near.id)" for m in range(1, n))
        steps.append(f"p{n} AS (SELECT DISTINCT ON (query_id) query_id, id, score FROM (SELECT *, round({gain}, 9) AS gain FROM near WHERE true{taken}) ORDER BY query_id, gain DESC, id)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT query_id, id, round(score, 5) AS score, CAST({n} AS BIGINT) AS rank FROM p{n}" for n in range(1, 6))


ORACLES = {
    "batch_request_jsonl": f"""WITH {_RPT} SELECT concat_ws('_', coalesce(report_year, 0)::VARCHAR, coalesce(report_name, ''), left(sha256(report_id::VARCHAR), 8)) AS custom_id, 'POST' AS method,
  md5(replace('{TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{input}}', report_text)) AS content_md5, CAST(4096 AS BIGINT) AS max_tokens FROM rpt WHERE trim(report_text, ' ') <> ''""",
    "batch_request_validation": f"WITH {_REQ}, v AS (SELECT list_filter(body.messages, lambda m: m.role = 'system')[1].content IS NOT NULL AS ok FROM req) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM v",
    "batch_result_parse": f"WITH {_STATUS} SELECT status, year, count(*) AS replies FROM fin GROUP BY ALL",
    "run_stats": f"WITH {_STATUS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE status <> 'SUCCESS') AS failed, round(100.0 * count(*) FILTER (WHERE status = 'SUCCESS') / count(*), 2) AS success_rate FROM fin",
    "user_message_parse": f"""WITH {_MSG} SELECT custom_id, md5(CASE length(m.content) % 6 WHEN 4 THEN '{{"other":1}}' WHEN 5 THEN '{{"action": "ask", "action_input": ' || m.content ELSE m.content END) AS question_md5 FROM msg WHERE m.role = 'user'""",
    "chat_history": f"WITH {_TURN} SELECT conv_id, turn, md5(coalesce(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history_md5 FROM turn",
    "conversation_title": f"WITH {_TURN} SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN coalesce(nullif(text, ''), CASE WHEN text IS NULL THEN '{{}}' ELSE '{{\"title\":\"\"}}' END) ELSE coalesce(nullif(trim(text, ' '), ''), conv_id) END) AS title_md5 FROM turn WHERE role = 'assistant'",
    "sse_frames": f"""WITH {_TURN}, k AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda t: length(t) > 0) AS t FROM turn WHERE role = 'assistant' AND text IS NOT NULL)
  SELECT conv_id, turn, CAST(len(t) + 4 AS BIGINT) AS frames, md5(coalesce(array_to_string(list_transform(t, lambda x: 'data: ' || x || chr(10) || chr(10)), ''), '')) AS tokens_md5 FROM k""",
    "token_stream_concat": f"WITH {_TURN} SELECT conv_id || '#' || turn AS conv_id, md5(text) AS answer_md5 FROM turn WHERE role = 'assistant' AND text <> ''",
    "session_get_or_create": "SELECT DISTINCT ON (response_id) response_id, coalesce(nullif(custom_id, ''), md5(response_id::VARCHAR)) AS conv_id FROM batch_responses",
    "manifest_delta": f"""WITH {_RPT}, c AS (SELECT DISTINCT file_path AS file FROM rpt WHERE file_path IS NOT NULL AND published_at >= TIMESTAMP '2019-01-01'), k AS (SELECT DISTINCT file_path AS file FROM rpt WHERE file_path IS NOT NULL AND ingested_at < TIMESTAMP '2021-01-01')
  SELECT file, 'new' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM k) UNION ALL SELECT file, 'deleted' FROM (SELECT * FROM k EXCEPT SELECT * FROM c)""",
    "content_addressed_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS first_key, count(*) AS copies, CAST(min(strlen(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "integrity_check": "SELECT title IS NOT NULL AS ok, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "chunk_fixed_window": """WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 1000) / 2000.0) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, unnest(range(n)) AS chunk_no FROM d)
  SELECT doc_id, chunk_no, CAST(length(substr(text, chunk_no * 2000 + 1, 3000)) AS BIGINT) AS size, md5(substr(text, chunk_no * 2000 + 1, 3000)) AS content_md5 FROM c""",
    "ingest_stream": """WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 1000) / 2000.0) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, n, length(substr(text, unnest(range(n)) * 2000 + 1, 3000)) AS size FROM d)
  SELECT doc_id, any_value(n) AS chunks, CAST(sum(size) AS BIGINT) AS characters FROM c GROUP BY doc_id""",
    "html_content": "SELECT doc_id, coalesce(title, '') AS title, md5(regexp_replace(coalesce(title, '') || text, '[\\s' || chr(160) || ']+', '', 'g')) AS content_md5 FROM documents WHERE text IS NOT NULL",
    "ioc_extract": f"SELECT kind, count(*) AS found, count(DISTINCT value) AS values FROM ({_IOC}) GROUP BY kind",
    "kv_line_parse": f"WITH {_LINES}, p AS (SELECT regexp_extract(value, '^\\s*([a-z]+)\\.([A-Za-z_]+):\\s*''(.*)''\\s*$', ['ns', 'key', 'item']) AS r FROM l) SELECT r.ns AS ns, r.key AS key, count(*) AS lines, count(DISTINCT nullif(r.item, '')) AS values FROM p WHERE r.ns <> '' GROUP BY ALL",
    "sensor_log_rollup": f"""WITH {_LINES}, e AS (SELECT value::JSON AS j FROM l WHERE starts_with(value, '{{"time"') AND json_valid(value))
  SELECT j->>'$.protocol' AS protocol, j->>'$.action' AS action, count(*) AS events, count(DISTINCT j->>'$.src') AS sources, round(min((j->>'$.time')::DOUBLE), 3) AS first, CAST(max((j->>'$.dport')::BIGINT) AS BIGINT) AS max_port FROM e GROUP BY ALL""",
    "ioc_list_scan": f"WITH {_LINES}, p AS (SELECT regexp_extract(value, '^(Domain|IP|md5|sha1|sha256|URL|Email Address),(\\S+)$', ['kind', 'item']) AS r FROM l) SELECT r.kind AS kind, count(*) AS lines, count(DISTINCT r.item) AS values FROM p WHERE r.kind <> '' GROUP BY ALL",
    "year_stats": f"""WITH {_RPT} SELECT coalesce(year(try_strptime(nullif(regexp_extract(report_name, '\\((\\d{{2}}-\\d{{2}}-\\d{{4}})\\)', 1), ''), '%m-%d-%Y')), TRY_CAST(list_filter(string_split(file_path, '/'), lambda p: regexp_full_match(p, '[0-9]{{4}}'))[1] AS BIGINT)) AS year,
  count(*) AS reports, CAST(sum(length(report_text)) AS BIGINT) AS characters FROM rpt GROUP BY ALL""",
    "ocr_routing": f"""WITH {_RPT}, p AS (SELECT report_text AS t, [substr(report_text, 1, 400), substr(report_text, 401, 400), substr(report_text, 801, 400)] AS pages FROM rpt)
  SELECT t IS NULL OR len(list_filter(pages, lambda x: length(x) > 100)) = 0 AS needs_ocr, CASE WHEN length(trim(t, ' ')) > 100 THEN 'SUCCESS' ELSE 'WARNING' END AS state, count(*) AS reports FROM p GROUP BY ALL""",
    "entity_extraction": f"WITH {_RPT}, f AS (SELECT DISTINCT * FROM ({_FOUND})) SELECT CASE WHEN kind = 'cve' THEN 'vul' ELSE 'ioc' END AS entity_type, kind AS sub_type, count(*) AS entities, count(DISTINCT report_id) AS reports FROM f GROUP BY ALL",
    "knn_ip": _NEAR.format(score=_SCORE, where="") + " SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
    "knn_l2": _NEAR.format(score=f"2 * {_SCORE} - list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) - list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])", where="") + " SELECT query_id, id, round(score, 5) + 0.0 AS score, rank FROM r WHERE rank <= 5",
    "knn_cosine_threshold": _NEAR.format(score="list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])", where="WHERE score >= 0.3") + " SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
    "knn_ivf_enough": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "chunk_recursive_sound": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS altered, CAST(0 AS BIGINT) AS blank FROM documents WHERE text IS NOT NULL",
    "text_embedding": "SELECT doc_id, CAST(64 AS BIGINT) AS size, CASE WHEN regexp_matches(title, '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents WHERE title IS NOT NULL",
    "mmr": _mmr(""),
    "mmr_threshold": _mmr("AND score >= 0.4"),
    "rag_context": _NEAR.format(score=_SCORE, where="") + f""" SELECT query_id, md5('{rag.HEADER.replace(chr(10), "' || chr(10) || '")}' || string_agg('[文档' || rank || '] 来源: ' || coalesce(title, '{rag.UNKNOWN}') || chr(10) || '内容: ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY rank)) AS context_md5, count(*) AS documents
  FROM r LEFT JOIN documents d ON d.doc_id = r.id WHERE rank <= 5 GROUP BY query_id""",
    "retrieval_eval": _NEAR.format(score=_SCORE, where="") + " SELECT count(*) AS pairs, count(*) FILTER (WHERE a.label = b.label) AS same_label FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 6 AND query_id <> id",
    "dict_or_list_normalise": "SELECT DISTINCT ON (mention_id) mention_id, array_to_string(entity_labels, ',') AS labels FROM entities WHERE entity_labels IS NOT NULL",
    "event_windows": _WINDOW.format(start="date_trunc('hour', ts)", source="events"),
    "event_windows_sliding": _WINDOW.format(start="s", source="(SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS s FROM events)"),
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, no""",
}
