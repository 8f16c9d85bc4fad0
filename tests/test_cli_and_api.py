"""The command line over small trees of files, and the entry points for programs."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veinstone import api, cli
from veinstone.functions import text as ft
from veinstone.operators import rag, vector
from veinstone.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    for year, name, text in ((2019, "a(01-02-2019)", "Seen at 203.0.113.7 and CVE-2019-1234."), (2020, "b", "Nothing here."), (2020, "c", " ")):
        path = tmp_path / "in" / str(year) / f"{name}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_prepare_process_extract(spark, tree, capsys):
    (tree / "template.txt").write_text("Extract:\n{input}")
    cli.main(["prepare", str(tree / "in"), str(tree / "requests"), "--template", str(tree / "template.txt")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"total": 2, "valid": 2, "invalid": 0}
    requests = [json.loads(r.value) for r in spark.read.text(str(tree / "requests")).collect()]
    assert sorted(r["body"]["messages"][1]["content"] for r in requests) == ["Extract:\nNothing here.", "Extract:\nSeen at 203.0.113.7 and CVE-2019-1234."]
    reply = {"custom_id": requests[0]["custom_id"], "response": {"body": {"choices": [{"message": {"content": "<Entitys></Entitys>"}}]}}}
    (tree / "replies.jsonl").write_text(json.dumps(reply) + "\n" + json.dumps(reply)[:-5] + "\n")
    cli.main(["process", str(tree / "replies.jsonl"), str(tree / "xml")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"total": 2, "succeeded": 1, "failed": 1, "success_rate": 50.0}
    cli.main(["extract", str(tree / "in"), str(tree / "graphs"), "--year", "2019"])
    row = spark.read.json(str(tree / "graphs")).collect()[0]
    assert sorted(e.EntityName for e in row.Entities) == ["203.0.113.7", "CVE-2019-1234"] and row.status == "MISSING_RELATIONS"


@pytest.mark.parametrize("how", ["tree", "suffix", "replace"])
def test_repair_files(spark, tree, how, capsys):
    (tree / "in/2019/x.xml").write_text("<Relationship><Source>a</Source><Target>b")
    cli.main(["repair-xml", str(tree / "in"), str(tree / "out"), "--files", how])
    at = {"tree": "out/2019/x.xml", "suffix": "in/2019/x.xml.fixed", "replace": "in/2019/x.xml"}[how]
    assert (tree / at).read_text() == "<Relationships><Relationship><Source>a</Source><Target>b</Target></Relationship></Relationships>"
    cli.main(["convert-xml", str(tree / "in"), str(tree / "routed")])
    assert not [p for p in Path(tree / "routed").rglob("*.json")]


def test_load_and_clear_graph(spark, tmp_path, capsys):
    entity = "named_struct('mention_id', {0}L, 'report_id', 1L, 'entity_id', 'e{0}', 'entity_name', '{1}', 'entity_type', 'tool', 'entity_sub_type', '{2}', 'entity_properties', map('k', 'v'), 'entity_labels', array('l'), 'entity_variant_names', array('n'), 'entity_times', array('1'))"
    tables = lambda rows: spark.sql(" union all ".join(f"select inline(array({entity.format(*r)}))" for r in rows)).write.parquet(str(tmp_path / "in/entities"), mode="overwrite")
    tables([(1, "a", "x"), (2, "b", "x")])
    spark.sql("select 1L relationship_key, 1L report_id, 'r' relationship_id, 'use' relationship_type, 'a' source_name, 'z' target_name").write.parquet(str(tmp_path / "in/relationships"))
    cli.main(["load-graph", str(tmp_path / "in"), str(tmp_path / "graph")])
    tables([(3, "b", "y"), (4, "c", "x")])
    cli.main(["load-graph", str(tmp_path / "in"), str(tmp_path / "graph")])
    nodes = {(r.label, r.name): r.subtype for r in spark.read.parquet(str(tmp_path / "graph/nodes")).collect()}
    assert nodes == {("Tool", "a"): "x", ("Tool", "b"): "y", ("Tool", "c"): "x", ("Entity", "z"): None, ("Entity", "a"): None}
    capsys.readouterr()
    cli.main(["clear-graph", str(tmp_path / "graph")])
    assert "nothing was cleared" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 5
    cli.main(["clear-graph", str(tmp_path / "graph"), "--confirm", "--properties"])
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).where("id is not null").count() == 0
    cli.main(["clear-graph", str(tmp_path / "graph"), "--confirm", "--stats"])
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 0 and spark.read.parquet(str(tmp_path / "graph/edges")).count() == 0


def test_replacement_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_table(spark, path, spark.sql("select 1 k, 1 t, 'a' v"), "k", "t")
    (tmp_path / "t").rename(tmp_path / "t.old")
    sinks.merge_table(spark, path, spark.sql("select 2 k, 2 t, 'b' v"), "k", "t")
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()


def test_settings_and_template(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# a comment\nllm:\n  model: 'm 1'\n  limits:\n    tokens: 5 # five\ntop: x\nexport KEY=\"v\"\n")
    assert files.settings(spark, str(tmp_path / "c.yaml")) == {"llm.model": "m 1", "llm.limits.tokens": "5", "top": "x", "KEY": "v"}
    (tmp_path / "t.txt").write_text("no slot")
    with pytest.raises(ValueError, match="input"):
        files.template(spark, str(tmp_path / "t.txt"))


def test_forms(spark):
    row = spark.sql("select '/x/2017/r.pdf' a, 'y/r 2015.pdf' b, 'z.pdf' c, 'k-1' k, 'k' l").select(*[ft.scan_year(F.col(c)) for c in "abc"], ft.safe_key(F.col("k")), ft.safe_key(F.col("l")), ft.is_web(F.lit("https://x"))).first()
    assert tuple(row) == ("2017", "2015", "unknown", "`k-1`", "k", True)
    assert spark.range(1).select(rag.error_frame(F.lit("no"))).first()[0] == 'event: error\ndata: {"error":"no"}\n\n'


def test_index_and_chat(spark, tmp_path):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = spark.createDataFrame([(n, f"d{n}", " ".join(rng.choices(words, k=4)) + f" only{n}") for n in range(80)], "id long, source string, content string")
    base = docs.select("id", vector.embed(F.col("content")).alias("vector"))
    index = api.VectorIndex(spark, str(tmp_path / "index"), base, 8)
    again = api.VectorIndex(spark, str(tmp_path / "index"))
    assert again.rows.count() == 80 and (again.centroids == index.centroids).all()
    asked = spark.createDataFrame([(1, "only7", None), (2, "only9", "user: hi")], "query_id long, question string, history string")
    said = {r.query_id: r for r in api.chat(asked, index, docs, vector.embed).collect()}
    assert "only7" in said[1].context and said[2].prompt.startswith("History:\nuser: hi")
    assert all(r.context == "" for r in api.chat(asked, index, docs, vector.embed, use_rag=False).collect())
    with pytest.raises(FileNotFoundError):
        api.VectorIndex(spark, str(tmp_path / "none"))


def test_vectors_of_high_dimension_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BASE_BYTES", 40_000)
    monkeypatch.setattr(vector, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(vector, "SCORE_BYTES", 1_000)
    rng = random.Random(3)
    rows = [(n, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(256)]) for n in range(120)]
    base = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in vector.top_k(base.withColumnRenamed("id", "query_id"), base, 3, "ip").collect()}
    for n, v in rows:
        best = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(v, r[1])), r[0]))[:3]
        assert [got[n, k + 1] for k in range(3)] == [r[0] for r in best]


def test_streams_are_watched_and_stopped(spark):
    import time

    from veinstone.streaming import pipelines

    batches, ended = [], []
    listener = api.Progress(batches.append, lambda *end: ended.append(end))
    spark.streams.addListener(listener)
    query = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("noop").start()
    waited = time.time()
    while not batches and time.time() - waited < 30:
        time.sleep(0.2)
    assert pipelines.stop(query, 10) and not query.isActive and batches
    while not ended and time.time() - waited < 40:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert ended and ended[0][1] is None


def test_parsers(spark):
    df = spark.createDataFrame([("<title>t</title><p>a</p>", "<Entity><EntityName>x")], "page string, xml string")
    row = df.select(api.PageParser().parse(F.col("page")).alias("p"), api.XmlParser().parse(F.col("xml")).alias("x")).first()
    assert tuple(row.p) == ("t", "t a") and row.x.Entities[0].EntityName == "x"
