"""Core queries with oracle SQL give the oracle's rows on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from veinstone.plans import registry

SF = "/root/testdata/sf0.001"


def _rows(frame):
    columns = sorted(frame.columns)
    text = lambda v: "" if v is None or str(v) == "<NA>" or v != v or str(v) == "NaT" else f"{v:.6f}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isinf(v) else str(v)
    return columns, sorted(tuple(text(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert _rows(frame) == _rows(duck.execute(registry.ORACLES[name]).df())
    else:
        assert len(frame.columns)


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
