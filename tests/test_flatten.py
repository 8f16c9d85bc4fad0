"""Nested records to flat tables."""

import json

from pyspark.sql import functions as F

from veinstone.operators import flatten


def found(spark, *texts):
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "graph_id long, graph_json string, pk string")
    out = flatten.flatten_graphs(rows)
    return out, {(r.graph_id, r.parent_pos, r.tag, r.item_key, r.item_value) for r in out.where(F.col("tag").isin("Labels", "Times", "Properties", "RelationshipType")).collect()}


def test_layouts(spark):
    entity = {"EntityName": "a", "Labels": {"Labels": ["x", None, "y"]}, "Times": 7, "Properties": {"p": 1.50, "n": {"q": [True, {"z": ""}]}, "e": [], "u": None}}
    nested = {"response": {"choices": [{"message": {"content": json.dumps({"Entities": {"Entity": {"Labels": [{"Label": "l"}], "Times": {"Time": ["1", 2]}, "Properties": {"Property": {"@name": "k", "#text": "v"}}}}})}}]}}
    pairs = {"Entities": [5, {"Properties": [{"name": "k", "value": "1"}, {"name": "m", "value": None}]}], "Relationships": {"RelationshipType": "use", "Source": "a"}}
    _, got = found(spark, json.dumps({"Entities": [entity], "Relationships": [{"RelationshipType": ""}, {"RelationshipType": None}]}), json.dumps(nested), json.dumps(pairs))
    assert got == {
        (0, 0, "Labels", "0", "x"), (0, 0, "Labels", "2", "y"), (0, 0, "Times", "0", "7"), (0, 0, "Properties", "p", "1.5"), (0, 0, "Properties", "n.q.0", "true"), (0, 0, "Properties", "n.q.1.z", ""), (0, 0, "RelationshipType", "", ""),
        (1, 0, "Labels", "0", "l"), (1, 0, "Times", "0", "1"), (1, 0, "Times", "1", "2"), (1, 0, "Properties", "k", "v"),
        (2, 1, "Properties", "k", "1"), (2, 0, "RelationshipType", "", "use"),
    }


def test_numbers_as_written_and_keys(spark):
    out, got = found(spark, '{"Entities": [{"EntityId": "e", "Times": [1.50, 1e3, 007]}]}', '{"Entities": [{"Times": [1.50, 1e3]}]}')
    assert got == {(1, 0, "Times", "0", "1.50"), (1, 0, "Times", "1", "1e3")}  # 007 is no JSON
    child, parent = out.where("tag = 'Times'").alias("c"), out.where("tag = 'entity'").alias("p")
    assert child.join(parent, F.col("c.parent_pk") == F.col("p.pk")).count() == 2


def test_broken_empty_and_deep(spark, tmp_path):
    deep = '{"a":' * 3000 + '{"Entities": [{"Times": ["1"]}]}' + "}" * 3000
    out, got = found(spark, None, "", "[]", '{"Entities": [{"Labels": ["x"', "null", '"text"', "{}", deep, json.dumps({"Entities": [{"Labels": ["x"] * 20000}]}))
    assert {g[0] for g in got} <= {7, 8} and sum(g[0] == 8 for g in got) == 20000
    flatten.write_tables(out, str(tmp_path / "t"))
    assert flatten.tables(spark.read.parquet(str(tmp_path / "t")))["labels"].count() == 20000
    assert found(spark)[1] == set()
