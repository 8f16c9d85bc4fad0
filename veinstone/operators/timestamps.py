"""Mixed timestamp formats and zones to one instant: an ordered cascade of anchored patterns, all in Catalyst expressions.

Each item is rewritten by the first pattern that matches it whole into `year|month|day|hour|minute|second|fraction|am/pm|zone`,
then parsed strictly. Policies: a local time that comes twice gives the earlier instant, one that is skipped moves forward by
the gap; parts not given are zero; a time without zone takes the zone of its source; an item of a source without a known zone
gives no instant unless it names its zone itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and their offsets from UTC.
ZONE_OFFSETS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00",
    "BST": "+01:00", "CET": "+01:00", "WEST": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "IST": "+05:30", "SGT": "+08:00", "HKT": "+08:00", "JST": "+09:00", "KST": "+09:00",
    "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "北京时间": "+08:00",
}

#: English month names by their first three letters.
MONTHS = {m: str(n) for n, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?:\s*[\[(（]?((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z_+-]+)+|北京时间)[\])）]?)?"
_TAIL = rf"(?:[Tt,\s]\s*{_CLOCK}{_ZONE})?"
_NAME = r"([A-Za-z]{3,9})\.?"

#: Ordered: (pattern, template). $-groups the pattern leaves out are empty.
PATTERNS: list[tuple[str, str]] = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})([Zz]?)$", "$1|$2|$3|$4|$5|$6|||$7"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TAIL}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}){_TAIL}$", "$3|?$1-$2||$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[-\s]{_NAME}[-\s,]\s*(\d{{4}}){_TAIL}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},\s+)?{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}}){_TAIL}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(?:(\d{{1,2}})[时:](\d{{1,2}})分?(?::?(\d{{1,2}})秒?)?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7"),
]


def _instants(rows: DataFrame) -> DataFrame:
    """Add utc_us to rows with raw, _zone and _order. Each select names what later ones use more than once, so that Catalyst
    keeps them apart and the generated code evaluates every pattern once a row."""
    rows = rows.withColumn("_t", F.regexp_replace("raw", r"^[\s 　]+|[\s 　]+$", ""))
    canon = F.lit(None).cast("string")
    for pattern, template in reversed(PATTERNS):
        canon = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, template)).otherwise(canon)
    rows = rows.withColumn("_p", F.split(canon, r"\|")).withColumn("_whole", F.regexp_extract("_t", r"^(\d{10,18})(?:\.(\d{1,9}))?$", 1))
    p, size = F.col("_p"), F.length("_whole")
    part = F.regexp_extract("_t", r"^(\d{10,18})(?:\.(\d{1,9}))?$", 2)
    tick = F.when(size <= 11, 1_000_000).when(size <= 13, 1_000).otherwise(1)
    amount = F.concat("_whole", F.lit("."), F.rpad(part, 9, "0")).try_cast("decimal(30,9)")
    named = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[F.lower(F.substring(p[1], 1, 3))]
    order = F.split(F.substring(p[1], 2, 9), "-")
    day_first = F.coalesce("_order", F.lit("")) == "DMY"
    numeric = F.coalesce(p[1].startswith("?"), F.lit(False))
    offset = r"^(?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?([+-])(\d{1,2}):?(\d{2})?$"
    rows = rows.select(
        *[c for c in rows.columns if c != "_t"],
        F.when((size > 0) & (size != 14), F.floor(amount * tick).try_cast("bigint")).alias("_epoch"),
        p[0].try_cast("int").alias("_y"),
        F.when(numeric, F.when(day_first, order[1]).otherwise(order[0])).when(p[1].rlike(r"^\d"), p[1]).when(_is_month(p[1]), named).try_cast("int").alias("_mo"),
        F.when(numeric, F.when(day_first, order[0]).otherwise(order[1])).otherwise(p[2]).try_cast("int").alias("_d"),
        *[F.when(p[n] == "", 0).otherwise(p[n].try_cast("int")).alias(c) for n, c in ((3, "_h"), (4, "_mi"), (5, "_s"))],
        F.rpad(F.substring(p[6], 1, 6), 6, "0").alias("_f"),
        F.lower(p[7]).alias("_half"),
        F.regexp_extract(p[8], offset, 1).alias("_sign"),
        F.lpad(F.regexp_extract(p[8], offset, 2), 2, "0").alias("_zh"),
        F.rpad(F.regexp_extract(p[8], offset, 3), 2, "0").alias("_zm"),
    )
    short = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])[F.upper(p[8])]
    hour = F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    zone = F.when(p[8] == "", F.col("_zone")).when(F.col("_sign") != "", F.concat("_sign", "_zh", F.lit(":"), "_zm")).when(p[8].contains("/"), p[8]).otherwise(short)
    rows = rows.withColumn("_hour", hour).withColumn("_at", zone)
    second = F.concat(F.col("_s").cast("string"), F.lit("."), F.col("_f")).try_cast("decimal(16,6)")
    strict = F.col("_hour").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59) & F.col("_at").isNotNull()
    stamp = F.try_make_timestamp("_y", "_mo", "_d", "_hour", "_mi", second, "_at")
    return rows.withColumn("utc_us", F.coalesce("_epoch", F.when(strict, F.unix_micros(stamp))))


def _is_month(name: Column) -> Column:
    """Whether name is an English month, whole or cut to three letters (or Sept)."""
    full = "january february march april may june july august september october november december sept".split()
    return F.lower(name).isin([*full, *MONTHS])


def normalise_times(items: DataFrame, feeds: DataFrame, key: str = "mention_id", times: str = "entity_times", feed: str = "feed_code") -> DataFrame:
    """One row (key, time_pos, raw, utc_us) per item of the array `times` that gives an instant.

    items: one row per key; feeds: one row per feed with home_zone and date_order, broadcast only when counted small.
    Null or empty arrays and null items give no rows; an unknown feed leaves zone-less items out and reads numeric dates month
    first; an empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    from veinstone.session import checked_broadcast

    lookup = feeds.select(F.col(feed).alias("_feed"), F.col("home_zone").alias("_zone"), F.col("date_order").alias("_order")).dropDuplicates(["_feed"])
    rows = items.select(F.col(key).alias("_key"), F.col(feed).alias("_of"), F.col(times).alias("_times"))
    rows = rows.where(F.size("_times") > 0).join(checked_broadcast(lookup), F.col("_of") == F.col("_feed"), "left")
    rows = rows.select("_key", "_zone", "_order", F.posexplode("_times").alias("time_pos", "raw"))
    rows = rows.where(F.col("raw").rlike(r"\d{4}"))  # every instant has four digits in a row
    # A filter on utc_us would be pushed below the projections and copy all of them into itself; a project with a
    # non-deterministic column holds it back.
    out = _instants(rows).withColumn("_here", F.spark_partition_id()).where(F.col("utc_us").isNotNull() & (F.col("_here") >= 0))
    return out.select(F.col("_key").alias(key), "time_pos", "raw", "utc_us")
