"""Variant spellings of names typed by people: pigeonhole segment join on the part of a name that tells it, then components.

A spelling is parsed to a profile: its key (family name, or the proper words of an organisation), what else must agree (given
name by nickname table, kinds of organisation) and an initial. Keys are cut into k + 1 segments; of two keys at most k edits
apart one segment is whole and moved by at most k places, so an inverted index over (block, length, segment number, segment)
finds all of them; a banded edit distance verifies. A swap across an edge breaks two segments; it is counted to the left one, so of
k + 1 segments one is whole but for, at most, its first letter swapped with the one before it, and that form is looked up too.
Blocks are what must agree anyway: the kinds, or an initial of the given name. Index and probes are made by Catalyst; a segment that
very many keys share is cut into blocks of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.name_forms import NICKNAMES, distance, parse
from veinstone.operators.components import connected_components
from veinstone.operators.skew import BLOCK_ROWS, join_hot, pairs_within
from veinstone.session import BROADCAST_ROWS, stored

#: Edits allowed between keys, by the length of the shorter: below 4 letters none, below 6 one.
EDITS = 2
#: A given name is a misspelling of another if the other stands with KNOWN family names at least, and with RATIO times as many.
KNOWN, RATIO = 3, 10
#: Two edits are a misspelling's only if its spelling has at most RARE mentions, or a third of those of what it may stand for.
RARE = 1

_PROFILE = ["sub", "key", "sure", "initial"]


def edits_for(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else EDITS


def _edits(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 6, 1).otherwise(EDITS)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(f"{s}|{n}", k, s, *p) for s, n, k in zip(batch["sub"], batch["name"], batch["rows"]) if (p := parse(n, s))]
        yield pd.DataFrame(rows, columns=["spelling", "rows", "sub", "key", "sure", "initial", "guess", "form"])


def _segments(length: Column, edits: Column) -> Column:
    """array<struct<n, at, size>>: the edits + 1 segments of a key of a length, the longer ones last."""
    parts = edits + 1
    size, longer = F.floor(length / parts).cast("int"), length % parts
    one = lambda n: F.struct(n.alias("n"), (n * size + F.greatest(F.lit(0), n - (parts - longer))).alias("at"), (size + F.when(n >= parts - longer, 1).otherwise(0)).alias("size"))
    return F.transform(F.sequence(F.lit(0), edits), one)


def _index(keys: DataFrame) -> DataFrame:
    length = F.length("key")
    rows = keys.where(length >= 4).select("sub", "block", "key", length.alias("length"), F.explode(_segments(length, _edits(length))).alias("s"))
    return rows.select("sub", "block", "length", F.col("s.n").alias("n"), F.substr("key", F.col("s.at") + 1, F.col("s.size")).alias("text"), F.col("key").alias("key_a"))


def _probes(keys: DataFrame) -> DataFrame:
    """What of a longer or equally long key may be a segment of a key: the segment's text in each place it may have moved to, as it
    is and with its first letter swapped with the one before."""
    length = F.length("key")
    lengths = F.filter(F.sequence(F.greatest(F.lit(4), length - EDITS), length), lambda n: n >= length - _edits(n))
    rows = keys.where(length >= 4).select("sub", "block", "key", F.explode(lengths).alias("length"))
    rows = rows.select("*", _edits(F.col("length")).alias("edits")).select("*", F.explode(_segments(F.col("length"), F.col("edits"))).alias("s"))
    last = F.least(F.length("key") - F.col("s.size"), F.col("s.at") + F.col("edits"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("s.at") - F.col("edits")), last)
    here = lambda at: F.substr("key", at + 1, F.col("s.size"))
    swapped = lambda at: F.concat(F.substr("key", at, F.lit(1)), F.substr("key", at + 2, F.col("s.size") - 1))
    texts = F.array_distinct(F.concat(F.transform(starts, here), F.transform(F.filter(starts, lambda at: at > 0), swapped)))
    return rows.where(last >= F.greatest(F.lit(0), F.col("s.at") - F.col("edits"))).select("sub", "block", "length", F.col("s.n").alias("n"), F.explode(texts).alias("text"), F.col("key").alias("key_b"))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        far = [distance(a, b, edits_for(min(len(a), len(b)))) for a, b in zip(batch["key_a"], batch["key_b"])]
        batch = batch.assign(edits=pd.Series(far, dtype="int32", index=batch.index))
        least = [edits_for(min(len(a), len(b))) for a, b in zip(batch["key_a"], batch["key_b"])]
        yield batch[batch["edits"] <= pd.Series(least, dtype="int32", index=batch.index)]


def near_keys(keys: DataFrame) -> DataFrame:
    """(sub, block, key_a, key_b, edits) of all keys of a block within the allowed edits, key_a < key_b.

    The index entries of a segment are cut into blocks of about BLOCK_ROWS by hash, and a probe meets each of them under a key of
    its own, so no task holds all keys of a hot segment.
    """
    at = ["sub", "block", "length", "n", "text"]
    keys = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # few rows become very many
    index = _index(keys)
    # A share of the index entries above which there can be no more hot segments than may be broadcast.
    most = max(BLOCK_ROWS, keys.count() * (EDITS + 1) // BROADCAST_ROWS)
    hot = index.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = stored(hot.select(*at, F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_cuts")), "hot")
    probes = _probes(keys)
    if hot.limit(1).count():
        hot, cuts = F.broadcast(hot), F.coalesce("_cuts", F.lit(1))
        index = index.join(hot, at, "left").withColumn("_cut", F.pmod(F.xxhash64("key_a"), cuts).cast("int")).drop("_cuts")
        probes = probes.join(hot, at, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
        at = [*at, "_cut"]
    # Spark takes exploded rows to be as few as those they come from and would gather them on the driver to broadcast them.
    found = index.join(probes.hint("merge"), at).where("key_a <> key_b").select("sub", "block", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    # A swap is two edits to Levenshtein; its distance, cheap in the JVM, leaves few pairs to verify.
    most = 2 * _edits(F.least(F.length("key_a"), F.length("key_b")))
    found = found.where((F.levenshtein("key_a", "key_b", 2 * EDITS) >= 0) & (F.levenshtein("key_a", "key_b", 2 * EDITS) <= most)).distinct()
    return found.mapInPandas(_verify, "sub string, block string, key_a string, key_b string, edits int")


def _misspelled(rare: Column, known: Column) -> Column:
    return (known >= KNOWN) & (rare <= F.greatest(F.lit(1), F.floor(known / RATIO)))


def _resolved(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings with `sure` settled and their profile, families of each given name as typed): a given name that is not in the table
    is the misspelling it may be if the form stands with far more family names than the word does."""
    typed = parsed.where("sub = 'user' and sure <> ''").select(F.when((F.col("guess") == "") & (F.col("form") != ""), F.col("form")).otherwise(F.col("sure")).alias("word"), "key")
    families = stored(typed.groupBy("word").agg(F.countDistinct("key").alias("families")), "given")
    unsure = parsed.where("guess <> ''")
    of = lambda c: families.select(F.col("word").alias(c), F.col("families").alias(f"{c}_families"))
    known = unsure.select("sure", "form").distinct().join(of("sure"), "sure").join(of("form"), "form")
    right = known.where(_misspelled(F.col("sure_families"), F.col("form_families"))).select("sure", "form", F.lit(True).alias("right"))
    settled = unsure.join(right, ["sure", "form"], "left").withColumn("sure", F.when(F.col("right"), F.col("guess")).otherwise(F.col("sure"))).drop("right")
    rows = parsed.where("guess = ''").unionByName(settled)
    return rows.select("spelling", "rows", *_PROFILE, F.concat_ws("|", *_PROFILE).alias("profile")), families


def _blocked(profiles: DataFrame) -> DataFrame:
    """Profiles by block: an organisation's is its kinds, a person's every initial of the given name's forms."""
    table = F.create_map(*[F.lit(x) for name, forms in NICKNAMES.items() for x in (name, ",".join(sorted({f[0] for f in [name, *forms.split()]})))])
    initials = F.coalesce(F.split(F.try_element_at(table, F.col("sure")), ","), F.array(F.left("sure", F.lit(1))))
    blocks = F.when(F.col("sub") == "org", F.array("sure")).when(F.col("sure") != "", initials).otherwise(F.array("initial"))
    return profiles.select("profile", "sub", F.explode(blocks).alias("block"), "key", "sure", "n")


def _links(blocks: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links(a, b) of profiles that stand for one entity, loose profiles whose initial fits several given names)."""
    at = ["sub", "block"]
    near = near_keys(blocks.select(*at, "key").distinct())
    same = blocks.groupBy(*at, "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*at, F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("edits"))
    side = lambda x: blocks.select(*at, *[F.col(c).alias(f"{c}_{x}") for c in ("profile", "key", "sure", "n")])
    given_a, given_b = (F.col("sure_a") != "") | (F.col("sub") == "org"), (F.col("sure_b") != "") | (F.col("sub") == "org")
    alike = F.when(given_a & given_b, F.when(F.col("sure_a") == F.col("sure_b"), "same").when(F.levenshtein("sure_a", "sure_b", 2) >= 0, "typed")).otherwise("initial")
    pairs = near.unionByName(same).join(side("a"), [*at, "key_a"]).join(side("b"), [*at, "key_b"]).where("profile_a <> profile_b").withColumn("alike", alike)
    pairs = stored(pairs.where((F.col("alike") == "same") | (F.col("alike").isNotNull() & (F.col("edits") < 2))).select("sub", "profile_a", "profile_b", "sure_a", "sure_b", "n_a", "n_b", "edits", "alike").distinct(), "pairs")

    # Given names one edit or swap apart, one of them rare and the other known.
    swapped = lambda c: F.array_sort(F.split(c, ""))
    typed = pairs.where("alike = 'typed'").where((F.levenshtein("sure_a", "sure_b", 1) >= 0) | (swapped("sure_a") == swapped("sure_b")))
    of = lambda x: families.select(F.col("word").alias(f"sure_{x}"), F.col("families").alias(f"f_{x}"))
    typed = typed.join(of("a"), "sure_a").join(of("b"), "sure_b").where(_misspelled(F.least("f_a", "f_b"), F.greatest("f_a", "f_b")))

    # An initial stands for a given name if only one stands with its family name, or with the nearest ones.
    ends = lambda p, q: pairs.where(f"alike = 'initial' and sure_{p} = '' and sure_{q} <> ''").select(F.col(f"profile_{p}").alias("p"), F.col(f"profile_{q}").alias("q"), F.col(f"sure_{q}").alias("sure"), "edits")
    fits = ends("a", "b").unionByName(ends("b", "a"))
    nearest = fits.groupBy("p").agg(F.min("edits").alias("edits"))
    choice = stored(fits.join(nearest, ["p", "edits"]).groupBy("p").agg(F.min("sure").alias("sure"), F.max("sure").alias("_other")), "initials")
    stands = fits.join(choice.where("sure = _other").select("p", "sure"), ["p", "sure"])
    both = pairs.where("alike = 'initial' and sure_a = '' and sure_b = ''")
    for end in ("profile_a", "profile_b"):
        both = both.join(choice.select(F.col("p").alias(end)), end, "left_anti")

    # Two edits are a misspelling of the rarer spelling, unless a spelling one edit from it explains it as well.
    one = pairs.where("edits = 1 and alike = 'same'")
    rivals = one.select(F.col("profile_a").alias("p"), F.col("n_b").alias("n")).unionByName(one.select(F.col("profile_b").alias("p"), F.col("n_a").alias("n"))).groupBy("p").agg(F.max("n").alias("rival"))
    two = pairs.where("edits = 2 and alike = 'same'")
    ends = lambda p, q: two.select(F.col(f"profile_{p}").alias("p"), F.col(f"profile_{q}").alias("q"), F.col(f"n_{p}").alias("n"), F.col(f"n_{q}").alias("m"))
    rare = ends("a", "b").unionByName(ends("b", "a")).where((F.col("n") <= RARE) | (3 * F.col("n") <= F.col("m")))
    far = rare.join(rivals, "p", "left").where("rival is null or rival < n")

    ab = [F.col("profile_a").alias("a"), F.col("profile_b").alias("b")]
    pq = [F.col("p").alias("a"), F.col("q").alias("b")]
    links = pairs.where("edits < 2 and alike = 'same'").select(*ab).unionByName(typed.select(*ab)).unionByName(both.select(*ab)).unionByName(stands.select(*pq)).unionByName(far.select(*pq))
    return links, choice.where("sure <> _other").select(F.col("p").alias("profile"))


def link_names(mentions: DataFrame, key: str = "mention_id", name: str = "entity_name", variants: str = "entity_variant_names", sub_type: str = "entity_sub_type") -> DataFrame:
    """(key, class): mentions of one person or organisation have one class.

    mentions: one row per key; sub types other than user and org are left out. Names of one row stand for one entity; null and
    blank names, codes and acronyms say nothing by themselves, and a mention with nothing else is a class of its own; tied and
    repeated spellings fall together; other columns are not read. Family names may differ by misspelling; given names must be
    forms of one name in the table, equal, or a rare misspelling of a known one; an initial counts for a given name only if a single
    one fits, else it is a spelling of its own that ties no rows.
    """
    rows = mentions.select(F.col(key).alias("_id"), F.col(sub_type).alias("sub"), F.concat(F.array(F.col(name)), F.coalesce(F.col(variants), F.array().cast("array<string>"))).alias("_names")).where(F.col("sub").isin("user", "org"))
    rows = stored(rows, "rows")
    names = rows.select("_id", "sub", F.explode("_names").alias("name")).where("name is not null")
    spelled = names.groupBy("sub", "name").agg(F.count(F.lit(1)).alias("rows"))
    parsed = stored(spelled.mapInPandas(_parsed, "spelling string, rows bigint, sub string, key string, sure string, initial string, guess string, form string"), "parsed")
    parsed, families = _resolved(parsed)
    parsed = stored(parsed, "spellings")
    profiles = parsed.groupBy(*_PROFILE, "profile").agg(F.sum("rows").alias("n"))
    links, loose = _links(stored(_blocked(profiles), "blocks"), families)
    links = stored(links.distinct(), "links")

    parsed = parsed.join(loose.withColumn("_loose", F.lit(True)), "profile", "left").select("spelling", "rows", "profile", F.coalesce("_loose", F.lit(False)).alias("loose"))
    spelling = names.select("_id", F.concat_ws("|", "sub", "name").alias("spelling"))
    of = stored(join_hot(spelling, stored(parsed, "profiles"), "spelling", "rows").select("_id", "profile", "loose").distinct(), "mentioned")
    first = of.groupBy("_id").agg(F.coalesce(F.min(F.when(~F.col("loose"), F.col("profile"))), F.min("profile")).alias("head"))
    tied = of.where("not loose").join(first, "_id").where("profile <> head").select(F.col("profile").alias("a"), F.col("head").alias("b")).distinct()
    labels = connected_components(parsed.select(F.col("profile").alias("node")).distinct(), links.unionByName(tied))
    sizes = first.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("_n")).join(labels, "node")
    classed = join_hot(first.withColumnRenamed("head", "node"), stored(sizes, "labels"), "node", "_n").select("_id", F.col("component").alias("class"))
    rest = rows.join(classed, "_id", "left_anti").select("_id", F.concat(F.lit("#"), F.col("_id").cast("string")).alias("class"))
    # Pairs read the classes four times; without a table of them the driver would plan all the above as often.
    return stored(classed.unionByName(rest), "classes").withColumnRenamed("_id", key)


def same_pairs(classed: DataFrame, key: str = "mention_id") -> DataFrame:
    """All pairs of mentions of one class, in blocks."""
    return pairs_within(classed, "class", key).select(f"{key}_a", f"{key}_b")
