"""Constraints, graph merges, streams."""

import time

import duckdb
from pyspark.sql import functions as F

from veinstone import vocab
from veinstone.operators import constraints, graph
from veinstone.plans import graph_queries
from veinstone.streaming import pipelines

ENTITIES = [
    (1, 1, "e1", "ev", "event"), (2, 1, "e2", "bob", "Victim"), (3, 1, "e3", "f", "file"), (4, 1, "e4", "bob", "attacker"), (5, 1, "e5", "n", None), (6, 2, "e1", "x", "attcker"),
]
RELATIONS = [
    (1, 1, "r1", "INVOLVE", "ev", "e2"), (2, 1, "r2", "has", "e2", "f"), (3, 1, "r3", "use", "ev", "nobody"), (4, 1, "r4", None, "ev", "bob"), (5, 1, "r5", "use", "ev", "f"), (6, 1, "r6", "use", "n", "f"), (7, 2, "r1", "target", "x", "x"),
]


def _tables(spark):
    e = spark.createDataFrame(ENTITIES, "pos long, report_id long, entity_id string, entity_name string, entity_type string")
    r = spark.createDataFrame(RELATIONS, "pos long, report_id long, relationship_id string, relationship_type string, source_name string, target_name string")
    return e, r


def test_constraints(spark):
    e, r = _tables(spark)
    got = {x.pos: (x.status, x.fixed_type) for x in constraints.check_relations(e, r).collect()}
    assert got == {1: ("valid", "INVOLVE"), 2: ("fixed", "trigger"), 3: ("unresolved", "use"), 4: ("error", None), 5: ("illegal", "use"), 6: ("error", "use"), 7: ("illegal", "target")}
    assert len(vocab.triples()) == 24 and len(vocab.candidates()) == 21


def test_graph(spark):
    e, r = _tables(spark)
    for c, t in (("entity_sub_type", "string"), ("entity_properties", "map<string,string>"), ("entity_labels", "array<string>"), ("entity_variant_names", "array<string>"), ("entity_times", "array<string>")):
        e = e.withColumn(c, F.lit(None).cast(t))
    nodes = graph.merge_nodes(e.unionByName(e.where("pos = 1").withColumns({"pos": F.lit(9).cast("long"), "entity_id": F.lit("late")})))
    assert {(x.label, x.name, x.id) for x in nodes.collect()} >= {("Event", "ev", "late"), ("Victim", "bob", "e2"), ("Attacker", "bob", "e4")}
    missing = graph.missing_endpoints(e, r)
    assert {x.name for x in missing.collect()} == {"e2", "nobody"}
    edges = graph.merge_edges(graph.bare_nodes(e).unionByName(missing), r)
    assert edges.where("source_name = 'ev' and target_name = 'bob'").count() == 0 and edges.where("type = 'HAS'").count() == 1
    hop = graph.k_hop(spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "a", "z")], "graph long, src string, dst string"), spark.createDataFrame([(1, "a")], "graph long, start string"), 2)
    assert {(x.node, x.hops) for x in hop.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.clear_graph(nodes, edges)[0].count() == nodes.count() and graph.clear_graph(nodes, edges, True)[0].count() == 0


def test_lists_of_nodes_against_sql(spark, tmp_path):
    """Lists that are null, empty, of nulls only and of both, in each list column; null and empty text are told apart."""
    lists = [None, [], [None], [None, None], [""], ["", None], [None, "a"], ["a", None, "b"]]
    rows = [(n, 1, f"e{n}", f"name {n}", x, "tool", None, x, x, {"k": None, "q": "é\n"}) for n, x in enumerate(lists)]
    rows.append((99, 1, "late", "name 6", [None], "TOOL", "sub", None, [None], None))
    schema = "mention_id long, report_id long, entity_id string, entity_name string, entity_variant_names array<string>, entity_type string, entity_sub_type string, entity_labels array<string>, entity_times array<string>, entity_properties map<string,string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "entities.parquet"))
    got = graph_queries.graph_nodes_upsert(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view entities as select * from '{tmp_path}/entities.parquet/*.parquet'")
    want = duck.execute(f"select {', '.join(got.columns)} from ({graph_queries.ORACLES['graph_nodes_upsert']})").fetchall()
    by = lambda rows: sorted(map(tuple, rows), key=lambda r: r[:2])
    assert by(got.collect()) == by(want)


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    source, target, state = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")
    schema = "doc_id long, text string"
    for n in (1, 2):
        spark.createDataFrame([(n, "x" * 25), (n + 10, None)], schema).coalesce(1).write.mode("append").parquet(source)
        pipelines.ingest(spark, source, target, state, schema, "doc_id", "text", 10, 2).awaitTermination()
    got = {r.doc_id: r["n"] for r in spark.read.parquet(target).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3, 2: 3}


def test_conversation_state(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "conv_id string, ts long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("conv_id string, ts long, text string").parquet(source)
    # A processing-time timeout keeps a stream going, so it is watched for its rows and then stopped.
    query = pipelines.conversation_turns(stream).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(120):
            got = {tuple(r) for r in spark.sql("select * from turns").collect()}
            if len(got) == 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert got == {("a", 0, "x"), ("a", 1, "z"), ("b", 0, "y")}
