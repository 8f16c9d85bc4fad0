"""Chunks, pages, vectors, retrieval, sources and sinks."""

import json
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinstone.functions import chunk, html
from veinstone.functions import text as ft
from veinstone.operators import ingest, rag, vector
from veinstone.sources import files, sinks


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n。", max_size=400), st.integers(5, 40))
def test_recursive_chunks(text, size):
    chunks = chunk.split_recursive(text, size, size // 3)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert set("".join(text.split())) <= set("".join(chunks)) and all(c in text for c in chunks)


def test_windows(spark):
    text = "".join(chr(97 + n % 26) for n in range(95))
    rows = spark.createDataFrame([(text,), ("abc",), ("",)], "t string").select(chunk.windows(F.col("t"), 30, 10).alias("c")).collect()
    assert ["".join(c.content) for c in rows[0].c] == [text[n : n + 30] for n in (0, 20, 40, 60, 80)][: len(rows[0].c)]
    assert rows[0].c[-1].content.endswith(text[-1]) and [c.content for c in rows[1].c] == ["abc"] and [c.content for c in rows[2].c] == [""]


def test_page():
    page = "<html><head><title>T</title><script>x<1</script><style>p{}</style></head><body><h1> A </h1><p>b &amp; c</p></body></html>"
    assert html.read_page(page) == html.read_page(page.encode()) == ("T", "T A b & c") and html.read_page("<p>x</p>") == ("", "x")


def test_scalar_functions(spark):
    row = spark.sql("select '/r/2017/A_b(13-45-2017).txt' p, '<Entitys>x</Entitys> <Relationships>y</Relationships>' r, '{\"data\":\"q\"}' m").select(
        ft.stem(F.col("p")), ft.extension(F.col("p")), ft.report_year(ft.stem(F.col("p")), F.col("p")), ft.xml_of_reply(F.col("r")), ft.user_question(F.col("m")), ft.needs_ocr(F.array(F.lit("a"), F.lit("b" * 101))), ft.title_of(F.lit(" "), F.lit("id")),
    ).first()
    assert tuple(row) == ("A_b(13-45-2017)", ".txt", 2017, "<Entitys>x</Entitys>\n<Relationships>y</Relationships>", "q", False, "id")


def _vectors(spark, n=400, size=8):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(n, size)).astype("float32")
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>")


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BYTES", 7 * 32)
    monkeypatch.setattr(vector, "BASE_BYTES", 64 * 32)
    data, base = _vectors(spark)
    queries = base.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    for metric, score in (("ip", lambda q: data @ q), ("l2", lambda q: -((data - q) ** 2).sum(1)), ("cosine", lambda q: data @ q / np.linalg.norm(data, axis=1) / np.linalg.norm(q))):
        got = {}
        for r in vector.top_k(queries, base, 5, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: np.argsort(-score(data[q].astype(float)))[:5].tolist() for q in range(0, 400, 50)}
    exact = vector.top_k(queries, base, 5)
    centroids = vector.fit_centroids(base, 8)
    found = vector.search_lists(queries, vector.build_lists(base, centroids), centroids, 5, 6)
    assert vector.evaluate(found, exact, 5).first()["recall"] >= 0.9
    assert vector.top_k(queries.limit(0), base).count() == 0 and vector.top_k(queries, base.limit(0)).count() == 0


def test_diversify(spark):
    data, base = _vectors(spark, 30)
    near = vector.top_k(base.where("id = 3").select(F.col("id").alias("query_id"), "vector"), base, 20).select("query_id", "id", "score").join(base, "id")
    rows = {r.id: r for r in near.collect()}
    picked = []
    while len(picked) < 5:
        gain = lambda i: 0.5 * rows[i].score - 0.5 * max((float(np.dot(data[i].astype(float), data[j].astype(float))) for j in picked), default=0) if picked else rows[i].score
        picked.append(max((i for i in sorted(rows) if i not in picked), key=lambda i: (round(gain(i), 9), -i)))
    assert [r.id for r in vector.diversify(near, 5).orderBy("rank").collect()] == picked


def test_embed_is_unit(spark):
    v = spark.sql("select 'The quick fox' t union all select ''").select(vector.embed(F.col("t"), 16)).collect()
    assert math.isclose(sum(x * x for x in v[0][0]), 1, rel_tol=1e-5) and set(v[1][0]) == {0.0}


def test_rag(spark):
    hits = spark.createDataFrame([(1, 2, None, "b"), (1, 1, "s", "a")], "query_id long, rank int, source string, content string")
    got = {r.query_id: r for r in rag.context(hits, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got[1].context.index("[文档1] 来源: s") < got[1].context.index("[文档2] 来源: 未知来源") and got[2].context == rag.NONE and got[2].documents == 0
    out = spark.range(1).select(rag.frames(F.lit("c"), F.lit("[]"), F.array(F.lit("a"), F.lit(""), F.lit("b")), F.lit("t"))).first()[0]
    assert out[0] == "data:[conversation_id]:c\n\n" and out[2:4] == ["data: a\n\n", "data: b\n\n"] and out[-1].startswith("event: complete\ndata: {") and len(out) == 6
    prompts = spark.createDataFrame([(1, "x")], "query_id long, q string").select("query_id", rag.prompt(F.lit(""), F.lit("one\ntwo"), F.col("q")).alias("prompt"))
    assert rag.answer(prompts).first().answer == "two"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/2017").mkdir(parents=True)
    (tmp_path / "in/notes").mkdir()
    (tmp_path / "in/2017/a(01-02-2018).txt").write_text("text")
    (tmp_path / "in/notes/b.txt").write_text("no year")
    (tmp_path / "in/2017/g.json").write_text(json.dumps({"Entities": [{"EntityId": "e", "Properties": {"k": "v"}}], "Relationships": []}))
    (tmp_path / "in/l.csv").write_text("﻿IP,1.2.3.4\nIP,1.2.3.4\nmd5,x\n")
    (tmp_path / "in/names.json").write_text('["a","a","b"]')
    (tmp_path / "in/r.jsonl").write_text('{"a": 1}\n\nbroken\n')
    root = str(tmp_path / "in")
    assert [(r.year, r.name, r.text) for r in files.report_tree(spark, root).collect()] == [(2017, "a(01-02-2018)", "text")]
    assert files.graph_files(spark, root + "/2017").first().Entities[0].Properties == {"k": "v"}
    assert files.indicator_list(spark, root + "/l.csv").count() == 2 and files.name_list(spark, root + "/names.json").count() == 2
    assert [r._corrupt_record is None for r in files.json_lines(spark, root + "/r.jsonl", "a int").collect()] == [True, False]
    assert files.documents(spark, root).where("page_content is not null").count() == 4
    rows = spark.createDataFrame([("s", n) for n in range(50)], "source string, n int")
    assert sorted((r.n, r.chunk_id) for r in sinks.chunks_with_number(rows, ["source", "n"]).collect()) == [(n, n) for n in range(50)]
    table = str(tmp_path / "t")
    for value in ("a", "b"):
        sinks.merge_table(spark, table, spark.createDataFrame([("k", value, 1), (value, value, 1)], "k string, v string, at int").withColumn("at", F.lit(ord(value))), "k", "at")
    assert {(r.k, r.v) for r in spark.read.parquet(table).collect()} == {("k", "b"), ("a", "a"), ("b", "b")}


def test_manifest(spark):
    t = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    assert {tuple(r) for r in ingest.manifest_delta(t("a", "b", "b"), t("b", "c")).collect()} == {("a", "new"), ("c", "deleted")}
