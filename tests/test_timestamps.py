"""Times against a brute-force parser on Python's own zone rules, and the stated policies case by case."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import Row

from veinstone.operators.timestamps import normalise_times

FEEDS = [Row(feed_code="b", home_zone="Europe/Berlin", date_order="DMY"), Row(feed_code="n", home_zone="America/New_York", date_order="MDY")]
SCHEMA = "mention_id long, feed_code string, entity_times array<string>, raw string, utc_us long"


def run(spark, rows):
    items = spark.createDataFrame(rows, SCHEMA)
    out = normalise_times(items, spark.createDataFrame(FEEDS, "feed_code string, home_zone string, date_order string"))
    return {(r.mention_id, r.time_pos): r.utc_us for r in out.collect()}


def us(*parts, zone=timezone.utc, fold=0):
    return int((datetime(*parts, tzinfo=zone, fold=fold) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


BERLIN, NEW_YORK = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2023-03-24 03:02:03.681", us(2023, 3, 24, 3, 2, 3, 681000, zone=BERLIN)),
    ("2019-10-16T21:46:14.048+02:00", us(2019, 10, 16, 19, 46, 14, 48000)),
    ("2022-04-08T05:53:37,3-04:00", us(2022, 4, 8, 9, 53, 37, 300000)),
    ("20161020T045445Z", us(2016, 10, 20, 4, 54, 45)),
    ("20200514221925", us(2020, 5, 14, 22, 19, 25, zone=BERLIN)),
    ("1520423548.581", 1520423548581000), ("1650152134", 1650152134000000), ("1552209866566", 1552209866566000), ("1719039966347150", 1719039966347150),
    ("09.02.2019 22:43", us(2019, 2, 9, 22, 43, zone=BERLIN)), ("03/04/2019 10:00:00", us(2019, 4, 3, 10, zone=BERLIN)), ("3-4-2019 12:05 am", us(2019, 4, 3, 0, 5, zone=BERLIN)), ("3/4/2019 12:05 PM", us(2019, 4, 3, 12, 5, zone=BERLIN)),
    ("May 27 2015, 15:34:11", us(2015, 5, 27, 15, 34, 11, zone=BERLIN)), ("June 8, 2021 9:09:27 PM GMT", us(2021, 6, 8, 21, 9, 27)), ("13 March 2019", us(2019, 3, 13, zone=BERLIN)), ("10-May-2020", us(2020, 5, 10, zone=BERLIN)),
    ("Sat, 09 Apr 2022 01:52:39 +0530", us(2022, 4, 8, 20, 22, 39)), ("10 Sep 2023 00:54 JST", us(2023, 9, 9, 15, 54)), ("2016-05-30 02:19 GMT+8", us(2016, 5, 29, 18, 19)),
    ("2024年1月19日 03:47:05", us(2024, 1, 19, 3, 47, 5, zone=BERLIN)), ("2022年9月13日21时18分（北京时间）", us(2022, 9, 13, 13, 18)), ("2015-12-14T14:32:03 Europe/Helsinki", us(2015, 12, 14, 12, 32, 3)),
    ("2024-03-26T10:02:25 America/Chicago", us(2024, 3, 26, 15, 2, 25)), ("2019-09-04T11:08:21[America/Los_Angeles]", us(2019, 9, 4, 18, 8, 21)), (" 2017-05-12 \t", us(2017, 5, 12, zone=BERLIN)),
    ("2023-10-29 02:30:00", us(2023, 10, 29, 2, 30, zone=BERLIN, fold=0)),  # comes twice: the earlier
    ("2023-03-26 02:30:00", us(2023, 3, 26, 1, 30)),  # skipped: an hour forward
    ("2019-02-30 08:00", None), ("31/31/2018 10:00", None), ("2017-13-45", None), ("25:61", None), ("stage 4", None), ("9", None), ("T+2h", None), ("later", None), ("", None), ("2020-01-01T10:00:00 Mars/Base", None),
    ("2020-01-01 24:00", None), ("2020-01-01 13:00 PM", None), ("12 Foo 2020", None),
]


def test_cases(spark):
    found = run(spark, [(1, "b", [c for c, _ in CASES], "x", 1)])
    assert {n: found.get((1, n)) for n in range(len(CASES))} == {n: want for n, (_, want) in enumerate(CASES)}


def test_order_of_the_feed(spark):
    found = run(spark, [(1, "n", ["03/04/2019 10:00:00", "03.04.2019"], None, None), (2, None, ["03/04/2019", "2019-03-04T00:00Z"], None, None)])
    assert found == {(1, 0): us(2019, 3, 4, 10, zone=NEW_YORK), (1, 1): us(2019, 4, 3, zone=NEW_YORK), (2, 1): us(2019, 3, 4)}


def test_nulls_empty_and_repeats(spark):
    assert run(spark, [(1, "b", None, None, None), (2, "b", [], None, None), (3, "b", [None, "soon", "2020-01-01 00:00Z"], None, None), (None, None, None, None, None)]) == {(3, 2): us(2020, 1, 1)}
    assert run(spark, []) == {}
    assert run(spark, [(1, "b", ["2020" * 50_000], None, None)]) == {}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_every_hour_around_changes(spark, zone):
    start, feed = datetime(2021, 3, 27), "b" if zone == "Europe/Berlin" else "n"
    hours = [start + timedelta(minutes=30 * n) for d in (0, 215, 224) for n in range(d * 48, d * 48 + 120)]
    found = run(spark, [(1, feed, [h.strftime("%Y-%m-%d %H:%M:%S") for h in hours], None, None)])
    for n, h in enumerate(hours):
        local = h.replace(tzinfo=ZoneInfo(zone))
        assert found[1, n] == int((local - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)), h
