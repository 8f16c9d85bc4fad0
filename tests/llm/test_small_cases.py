"""Defined results of every llm operator on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinstone.functions import nested
from veinstone.llm import collapse, encode, name_forms, names, pack, pairs, residue, scans, split
from veinstone.operators import flatten

ANSWER = "Attackers used a stolen password to reach the mail server. The report names no group."
TOLD = "Summarise the following report in three sentences."
REQUEST = TOLD + "\n\n" + "The intruders stole a password and moved to the mail server within a day. Nobody noticed it for weeks, although alarms had been raised."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), ("```xml\n```", "empty"), ("​ ﻿", "empty"), (ANSWER, None), ("No.", None), ("Yes", None), ("203.0.113.7", None), ("The text does not name a malware family.", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Leider kann ich dabei nicht helfen.", "refusal"), ("很抱歉，我拒绝回答这个问题。", "refusal"), ("Je ne peux pas vous aider sur ce point.", "refusal"), ("Lo siento, pero debo rechazar esta petición.", "refusal"),
        ('An operator wrote in the chat: "I can\'t help with that, ask the builder." The builder was not asked again.', None), ("The vendor replied that it was unable to comment on the incident.", None),
        (TOLD, "copied"), ("Q: " + TOLD, "copied"), (TOLD.upper(), "copied"), (TOLD.replace("the ", "", 1), "copied"), (REQUEST, "copied"), (TOLD + "\n" + TOLD, "copied"), (TOLD + "\n\n" + ANSWER, None),
        ("Attackers used a stolen password to reach the ma", "truncated"), ("<Entitys><Entity><EntityName>x</Enti", "truncated"), ("- 203.0.113.7\n- 9f799d945da5afafeed5d0b", "truncated"), ("- 203.0.113.7\n- hxxp://fazaro", "truncated"), ("<Entitys><Entity></Entity></Entitys>", None),
        ("Die Angreifer verschickten Nachrichten an die Verwaltung. Der Zugang war nicht gesichert.", "other_language"), ("攻击者利用未更新的远程服务进入内部网络。建议立即检查日志。", "other_language"), ("x " * 200_000 + "end.", None),
    ],
)
def test_pairs(answer, want):
    assert pairs.defect(answer, REQUEST) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("I'm sorry, I can't help with that. Thank you for asking. I wish you a good day. Do come back soon. Take care of yourself. All the best to you.", "refusal"),
        ("Thank you for your message. I value it. It is kind of you. I must decline to do this.", "refusal"), ("I have thought about it at length, weighing " + "all that could be said, and " * 20 + "in view of that I can't help with this.", "refusal"),
        ("I'd rather not answer that.", "refusal"), ("Desculpe, mas não posso ajudar com isso.", "refusal"), ("申し訳ありませんが、お答えできません。", "refusal"), ("Извините, но я не могу помочь.", "refusal"),
        ("The intruders stole a password and moved to the mail server within a day. Nobody noticed it for weeks, although alarms had been raised. I cannot provide more.", None),
        ("Os atacantes enviaram mensagens com um anexo manipulado e apagaram as cópias de segurança antes de sair da rede.", "other_language"), ("Злоумышленники отправили сообщения с вложением и удалили резервные копии.", "other_language"),
        ("A támadók ellopott jelszóval jutottak be a levelezőkiszolgálóra, és hetekig észrevétlenek maradtak.", "other_language"), ("Napadalci so ukradli geslo in vstopili v strežnik brez opozorila vseh nadzornikov.", "other_language"),
        ("- 203.0.113.7\n- evil.jp", None), ("- a.example\n- bad.site.ir", None), ("- 203.0.113.7\n- update.exe", None), ("- a.example\n- b.exam", "truncated"), ("We moved to version 1.2.3.", None),
    ],
)
def test_pairs_of_any_form(answer, want):
    assert pairs.defect(answer, REQUEST) == want


def test_values_cut_against_the_request():
    request = TOLD + "\n\nThe hosts were evil.jp, bad.site.ir and 198.51.100.70; the file was C:\\tmp\\update.exe."
    cases = {"- 203.0.113.7\n- evil.jp": None, "- evil.jp\n- bad.site.i": "truncated", "The data went to 198.51.100.7": "truncated", "The data went to 198.51.": "truncated", "The data went to 198.51.100.70.": None, "bad.sit": "truncated"}
    assert {a: pairs.defect(a, request) for a in cases} == cases


def test_pairs_recall(spark):
    """Planted defects of every kind over many sentences: at least 0.99 found, none in sound answers."""
    rng = random.Random(11)
    passage = [f"The {rng.choice(['group', 'crew', 'gang'])} {rng.choice(['moved', 'sent', 'copied'])} {rng.choice(['mail', 'data', 'tools'])} number {n} to the {rng.choice(['server', 'host', 'share'])} without notice." for n in range(400)]
    german = [f"Die Täter kopierten am Tag {n} die Daten von einem Rechner auf den anderen." for n in range(60)]
    rows, want = [], {}
    for n in range(600):
        told = rng.choice([TOLD, "Which hosts were used by the attackers?", "Give an overview of the attack described here."])
        said = rng.sample(passage, 6)
        request, sound = told + "\n\n" + " ".join(said), " ".join(rng.sample(said, 3))
        kind = ["empty", "truncated", "refusal", "copied", "other_language", None][n % 6]
        cut = rng.randrange(20, len(sound) - 12)
        decline = rng.choice(["I'm sorry, but I can't help with that.", "I must decline this request.", "I am unable to comply."])
        answer = {"empty": rng.choice(["", " \n", "```\n```"]), "truncated": sound[:cut].rstrip(" .") , "refusal": " ".join(rng.sample(["Thank you.", "Have a good day.", "Ask someone else.", decline], 4)), "copied": rng.choice([told, told.upper(), request]), "other_language": " ".join(rng.sample(german, 3)), None: sound}[kind]
        rows.append((n, answer, request))
        want[n] = kind
    got = {n: pairs.defect(a, r) for n, a, r in rows}
    wrong = [(n, want[n], got[n]) for n in want if got[n] != want[n]]
    assert len(wrong) <= 6 and not [w for w in wrong if w[1] is None]


def test_asked_language():
    assert pairs.defect("Die Angreifer kamen über das Netz und nahmen die Daten mit.", REQUEST.replace(TOLD, TOLD + " Answer in German.")) is None
    assert pairs.defect(ANSWER, REQUEST.replace(TOLD, TOLD + " Answer in German.")) == "other_language"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.common(a, b) == table[-1][-1]


def test_pair_tables(spark):
    requests = spark.sql(f"select 'a' custom_id, named_struct('messages', array(named_struct('role', 'user', 'content', '{TOLD}'))) body, 1 response_id union all select null, null, 2")
    choices = "array(named_struct('message', named_struct('content', {})))"
    one = lambda n, cid, nested, flat: f"select {n}L response_id, {cid} custom_id, named_struct('body', {nested}, 'choices', {flat}) response, 'x' answer"
    kind = f"cast(null as struct<choices: {'array<struct<message: struct<content: string>>>'}>)"
    flat = "cast(null as array<struct<message: struct<content: string>>>)"
    rows = [one(1, "'a'", f"named_struct('choices', {choices.format(repr(TOLD))})", flat), one(1, "'a'", f"named_struct('choices', {choices.format(repr(TOLD))})", flat), one(2, "'a'", kind, choices.format("'Fine.'")), one(3, "'a'", kind, flat), one(4, "null", kind, flat), one(5, "'b'", kind, flat)]
    responses = spark.sql(" union all ".join(rows))
    assert {tuple(r) for r in pairs.broken_pairs(requests, responses).collect()} == {(1, "copied"), (3, "empty")}
    assert pairs.broken_pairs(requests.limit(0), responses).count() == 0 and pairs.broken_pairs(requests, responses.limit(0)).count() == 0


def test_name_pairs_against_brute_force(spark):
    rng = random.Random(5)
    lasts = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]

    def typo(word):
        i = rng.randrange(1, len(word) - 1)
        return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("xqw") + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])

    rows = []
    for n, last in enumerate(lasts):
        first = ["Robert", "Margaret", "Thomas"][n % 3]
        nick = {"Robert": "Bob", "Margaret": "Peggy", "Thomas": "Tom"}[first]
        forms = [f"{first} {last.title()}", f"{last.title()}, {nick}", f"{first[0]}. {last.title()}", f"Dr. {first} {typo(last).title()}", f"{first} {last}".upper()]
        rows += [(len(rows) + k, f, None, "user", n) for k, f in enumerate(rng.sample(forms, 3))]
        rows += [(len(rows) + k, f, None, "org", n + 1000) for k, f in enumerate([f"{last.title()} Savings Bank", f"The {typo(last).title()} Sav. Bk.", f"Savings Bank of {last.title()}, GmbH"])]
    keys = {r[0]: name_forms.parse(r[1], r[3]) for r in rows}
    df = spark.createDataFrame([r[:4] for r in rows], "mention_id long, entity_name string, entity_variant_names array<string>, entity_sub_type string")
    classed = names.link_names(df)
    got = {(r.mention_id_a, r.mention_id_b) for r in names.same_pairs(classed).collect()}
    assert classed.count() == len(rows) and all(keys.values())
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[4] == b[4] and a[3] == b[3]}


def test_near_keys_against_brute_force(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(150)})
    df = spark.createDataFrame([("user", "x", k) for k in keys], "sub string, block string, key string")
    got = {(r.key_a, r.key_b): r.edits for r in names.near_keys(df).collect()}
    plain = lambda a, b: name_forms.distance(a, b, 2)
    want = {(a, b): plain(a, b) for a in keys for b in keys if a < b and plain(a, b) <= names.edits_for(min(len(a), len(b)))}
    assert got == want


def test_near_keys_miss_no_swap(spark):
    rng = random.Random(3)
    keys = {"smith", "simth", "abcd", "acbd"} | {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 10))) for _ in range(60)}
    for word in ["tombarova", "kelmudin", "pastor", "wexler"]:
        swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        keys |= {word} | {swap(word, i) for i in range(len(word) - 1)} | {swap(swap(word, i), j) for i in range(len(word) - 3) for j in range(i + 2, len(word) - 1)}
        keys |= {(s := swap(word, i))[:j] + x + s[j + 1 :] for i in range(len(word) - 1) for j in range(len(word)) for x in ("", "q")}
    keys = sorted(keys)
    df = spark.createDataFrame([("user", "x", k) for k in keys], "sub string, block string, key string")
    got = {(r.key_a, r.key_b): r.edits for r in names.near_keys(df).collect()}
    want = {(a, b): d for a in keys for b in keys if a < b and (d := name_forms.distance(a, b, 2)) <= names.edits_for(min(len(a), len(b)))}
    assert got == want and ("simth", "smith") in want


def test_name_tables(spark):
    schema = "mention_id long, entity_name string, entity_variant_names array<string>, entity_sub_type string, class string"
    rows = [(1, "MHD", ["Makeju Health Department"], "org", "x"), (2, "Makeju Health Dept.", None, "org", "x"), (3, "MHD", ["Mapudena Health Department"], "org", None), (4, None, None, "user", None), (5, " ", [None, ""], "user", None), (6, "Ann Fox", [], "ip", None), (7, "Bob " + "x" * 5000, None, "user", None)]
    classed = names.link_names(spark.createDataFrame(rows, schema))
    assert {(r.mention_id_a, r.mention_id_b) for r in names.same_pairs(classed).collect()} == {(1, 2)} and classed.count() == 6
    assert names.link_names(spark.createDataFrame([], schema)).count() == 0


def _classes(spark, names_):
    rows = [(n, x if isinstance(x, str) else x[0], None if isinstance(x, str) else list(x[1:]), "user") for n, x in enumerate(names_)]
    df = spark.createDataFrame(rows, "mention_id long, entity_name string, entity_variant_names array<string>, entity_sub_type string")
    by = {}
    for r in names.link_names(df).collect():
        by.setdefault(r["class"], set()).add(names_[r.mention_id] if isinstance(names_[r.mention_id], str) else names_[r.mention_id][0])
    return sorted(map(sorted, by.values()))


def test_initials_and_given_names(spark):
    got = _classes(spark, ["John Smith", "James Smith", "Jack Smith", "J. Smith", "Jane Smith", "Jacob Smith", ("Jim Smith", "J. Smith"), "Marta Kell", "Martin Kell", "Anna Holm", "Susanna Holm", "R. Zobal", "Robert Zobal", "Bob Zobal"])
    assert got == sorted([["J. Smith"], ["Jack Smith", "John Smith"], ["James Smith", "Jim Smith"], ["Jane Smith"], ["Jacob Smith"], ["Marta Kell"], ["Martin Kell"], ["Anna Holm"], ["Susanna Holm"], ["Bob Zobal", "R. Zobal", "Robert Zobal"]])


def test_two_edits_and_given_names_by_the_corpus(spark):
    known = [f"{given} {last}" for given in ("Xavier", "Richard") for last in ("Bandole", "Firmuta", "Gostawi", "Hulperin")]
    got = _classes(spark, ["Ann Kovalenka", "Ann Kovalenko", "Ann Kovolenke", "Xaveir Zopibova", "Xavier Zopibova", "Rcihard Tolmeru", "Rick Tolmeru", *known])
    assert [c for c in got if len(c) > 1] == [["Ann Kovalenka", "Ann Kovalenko", "Ann Kovolenke"], ["Rcihard Tolmeru", "Rick Tolmeru"], ["Xaveir Zopibova", "Xavier Zopibova"]]


def test_names_in_other_scripts(spark):
    got = _classes(spark, ["王小明", "王 小明", "李雷", "Иванов Пётр", "иванов петр", "Сидоров Олег", "…", "José Núñez", "Jose Nunez"])
    assert [c for c in got if len(c) > 1] == [["Jose Nunez", "José Núñez"], ["Иванов Пётр", "иванов петр"], ["王 小明", "王小明"]] and len(got) == 6


def test_near_keys_gather_no_exploded_rows(spark):
    """However few the keys, their probes, some sixty a key, don't pass through the driver."""
    df = spark.createDataFrame([("user", "x", k) for k in ("tombarova", "tombarovo", "kelmudin")], "sub string, block string, key string")
    near = names.near_keys(df)
    assert [(r.key_a, r.key_b) for r in near.collect()] == [("tombarova", "tombarovo")]
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_pairs_do_not_plan_the_classes_again(spark):
    rows = [(1, "Jon Tombarova", ["John Tombarova"], "user"), (2, "John Tombarova", None, "user"), (3, None, None, "org")]
    df = spark.createDataFrame(rows, "mention_id long, entity_name string, entity_variant_names array<string>, entity_sub_type string")
    pairs_ = names.same_pairs(names.link_names(df))
    assert [tuple(r) for r in pairs_.collect()] == [(1, 2)]
    assert pairs_._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3  # sizes to members on either side, and the pairs


def test_hot_segment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_ROWS", 5)
    keys = [f"kelmud{a}{b}" for a in "abcdefg" for b in "hijklm"] + ["kelmudah"]
    df = spark.createDataFrame([("user", "x", k) for k in sorted(set(keys))], "sub string, block string, key string")
    got = {(r.key_a, r.key_b): r.edits for r in names.near_keys(df).collect()}
    assert got == {(a, b): d for a in set(keys) for b in set(keys) if a < b and (d := name_forms.distance(a, b, 2)) <= 2}


def test_collapse(spark):
    a = '{"EntityName": "Big-Fox", "Properties": {"k": "V 1", "m": [1, 2]}}'
    rows = [(5, a), (2, '{"properties":{"M":[1,2],"K":"v1"},"entity_name":"bigfox"}'), (9, a), (9, a), (7, '{"EntityName": "Big-Fox", "Properties": {"k": "V 1", "m": [2, 1]}}'), (1, None), (3, ""), (4, " "), (6, "{broken"), (8, '{"EntityName": "' + "x" * 100_000 + '"}')]
    df = spark.createDataFrame(rows, "line_id long, raw_entity string").withColumn("kept", F.lit(1))
    classes, members = collapse.collapse(df)
    assert {(r.kept, r.copies) for r in classes.collect()} == {(2, 3), (7, 1), (3, 2), (6, 1), (8, 1)}
    assert {(r.line_id, r.kept) for r in members.collect()} == {(2, 2), (5, 2), (9, 2), (7, 7), (3, 3), (4, 3), (6, 6), (8, 8)}
    assert all(d.count() == 0 for d in collapse.collapse(df.limit(0)))


def test_collapse_of_many(spark, monkeypatch):
    """Hot texts, repeats and forgotten texts against brute force."""
    monkeypatch.setattr(collapse, "REMEMBERED", 3)
    rng = random.Random(4)
    forms = [f'{{"EntityName": "{rng.choice(["Big Fox", "big-fox", "BIGFOX"])} {n}", "k": {n % 2}}}' for n in range(12)]
    rows = [(n, rng.choice(forms[:1] * 10 + forms)) for n in range(400)]
    rows += rng.sample(rows, 40)
    df = spark.createDataFrame(rows, "line_id long, raw_entity string").repartition(5)
    least, count = {}, {}
    for n, raw in dict(rows).items():
        c = collapse.canonical(raw)
        least[c], count[c] = min(n, least.get(c, n)), count.get(c, 0) + 1
    classes, members = collapse.collapse(df)
    assert {(r.kept, r.copies) for r in classes.collect()} == {(least[c], count[c]) for c in least}
    assert sorted((r.line_id, r.kept) for r in members.collect()) == sorted((n, least[collapse.canonical(raw)]) for n, raw in dict(rows).items())


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4)), st.integers(0, 200), st.sampled_from(["", "]", "}", ",", '"', ":", " "]))
def test_deep_json_against_library(value, at, extra):
    text = json.dumps(value, indent=1)
    text = text[: at % (len(text) + 1)] + extra + text[at % (len(text) + 1) :]
    try:
        want = json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
    except ValueError:
        with pytest.raises(ValueError):
            nested._deep(text)
    else:
        assert nested._deep(text) == want


def test_deep_records():
    depth = 20_000
    a = '{"A": 1, "b": ' * depth + '"x"' + "}" * depth
    b = '{"b":' * depth + '"X"' + ',"a":1}' * depth
    assert collapse.canonical(a) == collapse.canonical(b) and collapse.canonical(a).startswith("{")
    graph = '{"Entities": [{"EntityName": "n", "Properties": ' + '{"p":' * depth + '"leaf"' + "}" * depth + "}]}"
    rows = list(flatten.visit(1, graph))
    assert [r[0] for r in rows] == ["entity", "Properties"] and rows[1][6] == "leaf"
    named = '{"Entities": [{"EntityName": "n", "Properties": [{"name": ' + '{"p":' * depth + '"leaf"' + "}" * depth + "}]}]}"
    assert [r[6] for r in flatten.visit(1, named) if r[0] == "Properties"] == ["leaf"]


PAGE = """Notes on Red Fox | 1

The intruders moved laterally and collected browser creden-
tials on the way to the server. The adversary prepared its
infrastructure several weeks before the first delivery, and
compromised routers forwarded traffic from there to a hid-

Page 2
NOTES ON RED F0X

den collection server. The aclversary prepared its second-
stage payload with pre- and post-exploitation tools that no
investigators had seen before this campaign was disclosed."""


def test_scans(spark):
    plain = "the adversary prepared its infrastructure and a second-stage payload with hidden credentials " * 12
    rows = [(1, PAGE, "Notes-on-Red-Fox-1(01-01-2020)", None), (2, plain, None, None), (3, None, None, None), (4, " ", "x", "y"), (5, "short", "x", "y"), (6, "word " * 100_000, None, None)]
    df = spark.createDataFrame(rows, "report_id long, report_text string, report_name string, feed_title string").withColumn("line", F.lit(1))
    got = {(r.key, r.line + 1, r.noise, r.word) for r in scans.scan_noise(df).collect()}
    assert got == {(1, 1, "header", ""), (1, 3, "hyphen", "credentials"), (1, 6, "hyphen", "hidden"), (1, 8, "page_number", ""), (1, 9, "header", ""), (1, 11, "misread", "adversary"), (1, 11, "hyphen", "second-stage")}
    text = {r.report_id: r.text for r in scans.repair_scans(df).collect()}
    assert len(text) == 5 and "browser credentials on the way" in text[1] and "a hidden collection server. The adversary prepared its second-stage payload with pre- and post-exploitation" in text[1] and "\n" not in text[1] and text[2] == plain
    assert scans.scan_noise(df.limit(0)).count() == 0


def test_title_with_each_word_misread():
    assert scans.furniture(["Tracking Magpie", "Trackinq Maqpie"], "Tracking Magpie") == {0: "header", 1: "header"}
    assert scans.furniture(["The operators moved on", "Trading Marble"], "Tracking Magpie") == {}
    rng = random.Random(9)
    for _ in range(3000):
        title = "".join(rng.choice("abc ") for _ in range(rng.randrange(6, 30))).strip()
        if len(title) < 6:
            continue
        core = list(title)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(core) - 1)
            core[k : k + 2] = rng.choice([[core[k + 1], core[k]], ["x", core[k + 1]], [core[k]], [core[k], "x", core[k + 1]]])
        core, most = "".join(core).strip(), max(1, min(3, len(title) // 7))
        if abs(len(core) - len(title)) <= 2 and scans.distance(core, title, most) <= most:
            assert scans._is_title(core, title, False)


def test_links_where_vectors_do_not_agree(spark):
    page = """Later that week the operators came back to the first server
and persistence was kept there through schedulecl tasks in a
renamed binary that no investigators had seen before on any
of the machines, and the implant asks again when resolution
fail"""
    plain = "the scheduled task launches a copy; " * 300 + "by means of scheduled tasks and a copy; " * 30 + "hosts fall back to others; " * 100
    filler = " ".join(f"{a}{b}{c}" for a in ("bo", "gu", "wy", "zo") for b in "abcdefghkmnoprstuvxyz" for c in ("pax", "tum", "sor", "wen"))
    df = spark.createDataFrame([(1, page, None, None), (2, plain, None, None), (3, (filler + " ") * 120, None, None)], "report_id long, report_text string, report_name string, feed_title string")
    df = df.withColumn("key", F.col("report_id")).withColumn("text", F.col("report_text")).withColumn("title", F.lit("")).withColumn("source", F.lit(""))
    texts = scans.read_texts(df)
    words = scans.count_words(texts)
    marks = frozenset(map(scans._mark, ("schedulecl", "scheduled", "fail", "fall")))
    vectors = {r.word: r.vector for r in scans.learn_vectors(texts, marks, scans._weights(words)).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b])) / (sum(x * x for x in vectors[a]) * sum(x * x for x in vectors[b])) ** 0.5
    assert cosine("schedulecl", "scheduled") < scans.AGREEMENT and cosine("fail", "fall") < scans.AGREEMENT
    got = {(r.line, r.noise, r.shown, r.word) for r in scans.scan_noise(df).collect()}
    assert got == {(1, "misread", "schedulecl", "scheduled")}


def test_vectors_tell_words_apart(spark):
    """Words of ten topics, each with words of its own around it: halves of a word's places give vectors alike, other words' do not."""
    rng = random.Random(6)
    topic = {t: [f"{x}{t}" for x in ("sa", "mo", "ki", "lu", "pe")] for t in ("ban", "dor", "fil", "gum", "hes", "jat", "kor", "lem", "nus", "pir")}
    texts = [" ".join(" ".join([rng.choice(own), "the", f"word{t}{half}", "of", rng.choice(own)]) for _ in range(8)) for t, own in topic.items() for half in "ab" for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("title", F.lit("")).withColumn("source", F.lit(""))
    read = scans.read_texts(df)
    names_ = [f"word{t}{half}" for t in topic for half in "ab"]
    vectors = {r.word: r.vector for r in scans.learn_vectors(read, frozenset(map(scans._mark, names_)), scans._weights(scans.count_words(read))).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    same = [cosine(vectors[f"word{t}a"], vectors[f"word{t}b"]) for t in topic]
    other = [cosine(vectors[f"word{t}a"], vectors[f"word{u}b"]) for t in topic for u in topic if t != u]
    assert sum(a > b for a in same for b in other) >= 0.95 * len(same) * len(other)


@pytest.mark.parametrize("width", [20, 25, 60, 140, 160, 300])
def test_text_of_any_width(width):
    rng = random.Random(width)
    words, lines = [rng.choice(["the", "server", "was", "reached", "by", "a", "stolen", "password", "and", "nobody", "saw", "it"]) for _ in range(60 + 2 * width)], [""]
    for w in words:
        if len(lines[-1]) + 1 + len(w) > width:
            lines.append("")
        lines[-1] += (" " if lines[-1] else "") + w
    assert scans.is_scanned(lines)
    assert not scans.is_scanned(["A short list", "of things", "that do not fill", "any width", "at all here and there"])


def test_long_header():
    title = "On the long road of the red fox " * 6
    assert scans.furniture(["some text that goes on", f"{title.strip()} | 7", "and more of it"], title.strip()) == {1: "header"}


def test_scans_recall(spark):
    """Planted noise over many pages: every header, number and break, and at least 0.99 of the misread words, without false ones."""
    rng = random.Random(12)
    lexicon = "the operators moved through network with stolen credentials while investigators collected evidence from several machines before containment because nobody had noticed unusual connections towards hidden infrastructure during months".split()
    rows, want = [], set()
    for n in range(60):
        title, lines, page = f"Tracking Group Number {n}", [], 1
        words = [rng.choice(lexicon) for _ in range(330)]
        line = ""
        while words:
            w = words.pop(0)
            if len(line) + 1 + len(w) > 60:
                if len(w) > 7 and rng.random() < 0.15:
                    want.add((n, len(lines), "hyphen", w))
                    lines.append(f"{line} {w[:4]}-")
                    line = w[4:]
                    continue
                lines.append(line)
                line = ""
                if len(lines) % 12 == 0:
                    want |= {(n, len(lines), "page_number", ""), (n, len(lines) + 1, "header", "")}
                    lines += [f"Page {page}", title.upper()]
                    page += 1
            if "m" in w and rng.random() < 0.012:
                want.add((n, len(lines), "misread", w))
                w = w.replace("m", "rn", 1)
            line += (" " if line else "") + w
        rows.append((n, "\n".join(lines), title, None))
    df = spark.createDataFrame(rows, "report_id long, report_text string, report_name string, feed_title string")
    got = {(r.key, r.line, r.noise, r.word) for r in scans.scan_noise(df).collect()}
    last = {(n, len(r[1].split("\n"))) for n, r in enumerate(rows)}
    want = {w for w in want if (w[0], w[1]) not in last}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


@settings(max_examples=150, deadline=None)
@given(st.text("abc  \n。.，x", max_size=300), st.integers(8, 60), st.integers(0, 7))
def test_split_covers(text, limit, overlap):
    cut = split.cuts(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 <= e - s <= limit for s, e, _ in cut)
    for (s, e, _), (s2, e2, _) in zip(cut, cut[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
    run = max((len(r) for r in re.split(r"[\s。！？；，]", text)), default=0)
    if len(text) > limit:
        assert any(c == "forced" for _, _, c in cut) == (run > limit)


def test_split_prefers_strength():
    text = "a" * 10 + ". " + "b" * 10 + "\n\n" + "c" * 10 + " " + "d" * 30
    assert split.cuts(text, 40, 5)[0][1] == text.index("c")
    assert split.cuts("", 10, 2) == [(0, 0, "end")] and split.cuts("x" * 25, 10, 4)[0] == (0, 10, "forced")


def test_split_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 2000), (3, "word " * 2000)], "report_id long, report_text string").withColumn("text", F.lit("x"))
    assert {(r.key, r["n"]) for r in split.split_texts(df, "report_id", "report_text").withColumnRenamed("report_id", "key").groupBy("key").agg(F.count("*").alias("n")).collect()} == {(2, 1), (3, 10)}
    assert split.split_texts(df.limit(0), "report_id", "report_text").count() == 0


def test_long_stretches():
    text = "".join(random.Random(1).choice(["alpha ", "beta, ", "gamma. ", "delta\n"]) for _ in range(200_000))
    cut = split.cuts(text)
    assert len(text) > split.STRETCH and all(c != "forced" for _, _, c in cut) and all(e - s <= 3000 for s, e, _ in cut)


@pytest.fixture(scope="module")
def bpe():
    return encode.tokenizer(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_perfect_hash(bpe):
    assert sorted(bpe.hash.slots.tolist()) == list(range(bpe.hash.n)) and (bpe.hash.places(bpe.entries) == list(range(bpe.hash.n))).all()


def test_encode_against_library(bpe):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", " ", "Hello  world's <|endoftext|>", "攻击者利用 CVE-2020-1", "é́ ퟿😀\n\n\t x", "a" * 5000, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), *["".join(rng.choice(" ab1.é中\n") for _ in range(60)) for _ in range(60)]]
    assert bpe.encode(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_encode_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (3, "ab")], "doc_id long, text string").withColumn("ids", F.lit(1))
    assert sorted((r.doc_id, len(r.ids)) for r in encode.encode_texts(df).collect()) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert encode.encode_texts(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    intervals, containers = pack.plan(histogram, 40)
    used, count = {}, {}
    for size, first, many, container, per in intervals:
        for r in range(many):
            c = container + r // per
            used[c] = used.get(c, 0) + size
        count[size] = count.get(size, 0) + many
    assert count == histogram and all(u <= 40 for u in used.values()) and len(used) == containers
    gaps = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((40 if fit is None else fit) - size)
    assert sorted(gaps) == sorted(40 - u for u in used.values())


def test_pack_tables(spark):
    df = spark.createDataFrame([(n, s) for n, s in enumerate([None, 0, 5, 5, 7, 25, 10, 3, 5])], "doc_id long, tokens long").withColumn("size", F.lit(1))
    rows = pack.pack(df, capacity=10).collect()
    used = {}
    for r in rows:
        if r.container is not None:
            used[r.container] = used.get(r.container, 0) + r["size"]
    assert sorted(used.values()) == [10, 10, 10, 10, 10, 10] and sum(r.container is None for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) == 3
    assert pack.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack.pack(df, capacity=pack.MOST_CAPACITY + 1)


RESIDUE = [
    ("Version {{ title }}, last changed on [TODO: date]\nDear %CLIENT%, see <report date>.", "placeholder"), ("Lorem ipsum dolor sit amet consectetur. Magna nulla sapien mauris.", "filler"), ("asdf asdf asdf asdf asdf asdf", "filler"), ("Type your text here.\nTexte à remplacer avant publication.", "filler"),
    ("Home | About\n404 Not Found\nThe requested address was not found on this server.\nRequest id: 7f3a", "error_page"), ("Zugriff verweigert\nBitte versuchen Sie es später erneut.", "error_page"), ("页面不存在\n请检查地址后重试。", "error_page"),
    ("Please enable JavaScript to continue. Reload the page afterwards.", "script_notice"), ("请启用JavaScript后再访问本页面。", "script_notice"),
    ('Requests with the wrong key received "Access denied" and a random reference number.', None), ("The phishing kit leaves {{email}} in the page source, which allows hunting for it. The group was active in May.", None), ("The builder holds the literal ${HOME}/.cache/x and expands it at run time.", None), ("The panel returned 503 Service Unavailable whenever the operators went offline.", None), ("Several advisories recommend that readers disable JavaScript in the document viewer.", None),
    (None, None), ("", None), ("  \n", None), ("Plain report of an attack. " * 20_000, None),
]


@pytest.mark.parametrize("pattern", residue.FILLERS + residue.ERRORS + residue.SCRIPTS)
def test_no_pattern_is_scanned_over(pattern):
    @settings(max_examples=15, deadline=None, database=None)
    @given(st.from_regex(pattern, fullmatch=True))
    def run(text):
        assert not re.search(pattern, text.lower(), re.I) or residue._HINT.search(text.lower())

    run()


@pytest.mark.parametrize(
    ("text", "want"),
    [(t, "filler") for t in ("Example page", "Demo content", "Sample article", "Example paragraph", "Add some content here.", "Enter your description here", "Write some words here", "Auctor congue cras.", "asdf, asdf, asdf, asdf. Read on.")]
    + [(t, "error_page") for t in ("La page n’existe plus.", "The page doesn’t exist.", 'Not"x"found')] + [("JS must be enabled", "script_notice"), ("[ TODO ]", "placeholder"), *[(t, None) for t in ("The example page of the kit lists its victims by country.", "A decoy document filled with lorem ipsum hid the macro from casual readers.")]],
)
def test_residue_without_usual_hints(spark, text, want):
    got = residue.template_residue(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).collect()
    assert [r.residue for r in got] == ([want] if want else [])


def test_residue(spark):
    df = spark.createDataFrame([(n, t, None if n % 2 else "h") for n, (t, _) in enumerate(RESIDUE)], "doc_id long, text string, source string").withColumn("key", F.lit(1))
    got = {r.doc_id: r.residue for r in residue.template_residue(df).collect()}
    assert got == {n: want for n, (_, want) in enumerate(RESIDUE) if want}
    assert residue.template_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [(t, "script_notice") for t in ("Please turn on JS to continue.", "Please activate JS.", "This page requires JS.", "JS must be enabled", "Turn on script support.", "You need to turn on scripts in your browser to read this page.")]
    + [(t, "filler") for t in ("Demo article", "Sample article", "Example page.", "Insert your words here.", "Add some words.", "Put some content.", "Dolor sit amet elit sed do eiusmod tempor.")]
    + [(t, "error_page") for t in ("410-gone", "The site is down for maintenance Please try again in a few minutes.", "Request timed out Request id: ea2d8990dbd4f996", "访问被拒绝 请联系管理员，编号65dc8bdf 请检查地址后重试。")]
    + [(f'The notice read {a}{"the server said access denied and not found, " * 20}{b} for weeks.', None) for a, b in ('""', "“”", "„“", "''", "``", "「」", "«»")]
    + [("Security advisories recommend that readers disable JavaScript in the document viewer.", None), ("The panel returned 503 Service Unavailable whenever the operators went offline.", None)],
)
def test_residue_of_any_form(text, want):
    assert residue.residue([text], [False]) == want


def test_residue_recall():
    """Planted residue with site navigation around it: every kind found, none in reports that mention it."""
    rng = random.Random(8)
    navigation = ["Home | Reports | About", "© 2020 Exchange. All rights reserved.", "Share  Print  Save", "Previous article  Next article", "We use cookies to improve this site."]
    kinds = {
        "placeholder": ["Dear {{name}}, welcome to [INSERT TITLE].", "Report of %DATE% by <author name>", "${SUBJECT}"], "filler": ["Lorem ipsum dolor sit amet.", "Your text here.", "blah blah blah blah"],
        "error_page": ["404 Not Found", "Seite nicht gefunden", "Accès refusé", "Internal server error"], "script_notice": ["Please enable JavaScript.", "JavaScript ist deaktiviert.", "请启用JavaScript"],
    }
    report = ["The group stole data from a server in May.", 'The page showed "404 Not Found" to all others.', "Readers should disable JavaScript in the viewer, as advisories recommend.", "The kit leaves {{email}} in the source, which helps hunting."]
    wrong = 0
    for n in range(2000):
        kind = rng.choice([*kinds, None])
        lines = rng.sample(navigation, rng.randrange(4)) + ([rng.choice(kinds[kind])] if kind else [" ".join(rng.sample(report, 3))])
        rng.shuffle(lines)
        wrong += residue.residue(lines, [False] * len(lines)) != kind
    assert wrong <= 20
