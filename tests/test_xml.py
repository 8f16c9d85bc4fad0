"""XML repair and parsing."""

import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinstone.operators import xmlparse, xmlrepair


def test_wrong_closer():
    fixed = xmlrepair.repair("<Relationships><Relationship><RelationshipId>r1</RelationshipType><RelationshipType>use</RelationshipType></Relationship></Relationships>")
    assert "<RelationshipId>r1</RelationshipId>" in fixed and ET.fromstring(fixed) is not None


def test_missing_closers():
    fixed = xmlrepair.repair("<Relationships><Relationship><Source>a</Source><Target>b")
    assert all(f"</{t}>" in fixed for t in ("Target", "Relationship", "Relationships"))


def test_declaration_wrappers_prose_and_text():
    fixed = xmlrepair.repair('<?xml version="1.0"?>\nSure:\n<Entity><EntityName>A & B</EntityName><Property name=k>v</Property></Entity>\nDone.')
    assert fixed.startswith("<?xml") and "Sure" not in fixed and "A &amp; B" in fixed and '<Property name="k">' in fixed and fixed.rstrip().endswith("</Entitys>")
    ET.fromstring(fixed.split("?>", 1)[1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<Entitys><Entity><Labels><Label>x</Labels><Label>y</Label></Labels></Entity></Entitys>", "<Entitys><Entity><Labels><Label>x</Label><Label>y</Label></Labels></Entity></Entitys>"),
        ("<Relationship><Source>a</Relationship><Target>b</Targ", "<Relationships><Relationship><Source>a</Source><Target>b</Target></Relationship></Relationships>"),
        ("<Relationship><Target>b</Relationship><Relationship><Target>c", "<Relationships><Relationship><Target>b</Target></Relationship><Relationship><Target>c</Target></Relationship></Relationships>"),
        ("<Entity><EntityName>a < b <c> d &amp;</EntityName></Entity></Entity>", "<Entitys><Entity><EntityName>a &lt; b &lt;c&gt; d &amp;amp;</EntityName></Entity></Entitys>"),
        ("<Source>a</Source><Entity><EntityName/></Entity>", "<Entitys><Entity><EntityName></EntityName></Entity></Entitys>\n<Relationships><Relationship><Source>a</Source></Relationship></Relationships>"),
        ("a & b", "a &amp; b"), ("", ""), ("<Entity><Property name='a\"b&c' >1</Property>", '<Entitys><Entity><Property name="a&quot;b&amp;c">1</Property></Entity></Entitys>'),
    ],
)
def test_repair(text, want):
    assert xmlrepair.repair(text) == want


def test_unclosed(spark):
    df = spark.createDataFrame([("<Entity><EntityId>x</EntityId><EntityName a='b'>",), ("<Label>",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(xmlrepair.unclosed(F.col("x"))).collect()] == [{"Entity": 1, "EntityName": 1}, {"Label": 1}, {}, {}]


def test_sections_alone(spark):
    good, bad = "<Entitys><Entity><EntityName>a</EntityName></Entity></Entitys>", "<Relationships><Relationship><Source>s</Relationship></Relationships>"
    right, wrong = "<Relationships><Relationship><Source>s</Source></Relationship></Relationships>", "<Entitys><Entity><EntityName>a</Entity></Entitys>"
    stray = "<Root><Entity><EntityName>b</EntityName></Entity><Entitys><Entity><EntityName>a</EntityName></Entity></Entitys></Root>"
    df = spark.createDataFrame([(good + bad,), (wrong + right,), (wrong + bad,), (stray,), ("x & y" + good,)], "x string").select(xmlparse.parse_xml(F.col("x")).alias("g"))
    got = [([e.EntityName for e in r.g.Entities or []], [e.Source for e in r.g.Relationships or []], r.s) for r in df.withColumn("s", xmlparse.status_of(F.col("g"))).collect()]
    assert got == [(["a"], [], "MISSING_RELATIONS"), ([], ["s"], "MISSING_ENTITIES"), ([], [], "ERROR"), (["a", "b"], [], "MISSING_RELATIONS"), (["a"], [], "MISSING_RELATIONS")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc XYZ.-", max_size=8), st.text("abc", max_size=5)), max_size=4))
def test_well_formed_stays(entities):
    text = "<Entitys>" + "".join(f"<Entity><EntityName>{a}</EntityName><EntityType>{b}</EntityType></Entity>" for a, b in entities) + "</Entitys>"
    read = lambda t: [(e.findtext("EntityName"), e.findtext("EntityType")) for e in ET.fromstring(t).iter("Entity")]
    assert read(xmlrepair.repair(text)) == read(text)


def test_parse_fallbacks(spark):
    rows = [
        ("<Entitys><Entity><EntityId>e</EntityId><Times><Time>1</Time><Time>2</Time></Times><Properties><Property name='a'>1</Property><Property name='a'>2</Property><Property>x</Property><Property name='b'/></Properties></Entity></Entitys><Relationships></Relationships>",),
        ("<Entitys><Entity><Time>3</Time><Label>l</Label><EntityName></EntityName></Entity></Entitys>\n<Relationships><Relationship><Source>s</Source></Relationship></Relationships>",),
        ("<Entitys><Entity></Entitys>",), ("no xml",), (None,),
    ]
    df = spark.createDataFrame(rows, "x string").select(xmlparse.parse_xml(F.col("x")).alias("g"))
    got = [(r.g, r.s) for r in df.withColumn("s", xmlparse.status_of(F.col("g"))).collect()]
    first = got[0][0].Entities[0]
    assert first.Times == ["1", "2"] and first.Properties == {"a": "2", "b": ""} and got[0][1] == "MISSING_RELATIONS"
    assert got[1][0].Entities[0].Times == ["3"] and got[1][0].Entities[0].EntityName is None and got[1][1] == "SUCCESS"
    assert got[2][1] == "ERROR" and got[3][1] in ("MISSING_ENTITIES", "ERROR") and got[4][1] == "ERROR"


def test_event_facts(spark):
    df = spark.sql("select named_struct('EntityType', t, 'Properties', p) e from values ('event', map('observe_time', 'x', 'k', 'v')), ('Event', map('k', 'v')), ('event', null) as r(t, p)")
    got = [r[0] for r in df.select(xmlparse.with_event_facts(F.col("e"), F.lit(2020), F.lit(None).cast("string"))).collect()]
    assert got == [{"observe_time": "2020", "k": "v"}, {"k": "v"}, {"observe_time": "2020"}]
