"""Scalar text functions: names, paths, years, model replies, user messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_of_reply(reply: Column) -> Column:
    """The first Entitys and the first Relationships section, each on lines of its own; else a fenced xml block; else the reply."""
    entities = F.regexp_extract(reply, r"(?s)<Entitys>.*?</Entitys>", 0)
    relations = F.regexp_extract(reply, r"(?s)<Relationships>.*?</Relationships>", 0)
    fenced = F.regexp_extract(reply, r"(?s)```xml\s*(.*?)\s*```", 1)
    both = F.concat(F.when(entities != "", F.concat(entities, F.lit("\n"))).otherwise(""), relations)
    return F.when((entities != "") | (relations != ""), both).when(fenced != "", fenced).otherwise(reply)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, else an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def year_of_name(name: Column) -> Column:
    """The year of a date (MM-DD-YYYY) in a name; null if there is none or it is impossible."""
    return F.year(F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"\((\d{2}-\d{2}-\d{4})\)", 1), F.lit("")), F.lit("MM-dd-yyyy")))


def year_of_path(path: Column) -> Column:
    """The first directory that is a year of four digits."""
    return F.get(F.filter(F.split(path, "/"), lambda p: p.rlike("^[0-9]{4}$")), F.lit(0)).cast("int")


def report_year(name: Column, path: Column) -> Column:
    return F.coalesce(year_of_name(name), year_of_path(path))


def scan_year(path: Column) -> Column:
    """The year of a scanned file as text: the parent directory if it is one of this century, else the first such year in the name,
    else "unknown"."""
    parent = F.regexp_extract(path, r"(?:^|/)(20\d{2})/[^/]*$", 1)
    named = F.regexp_extract(base_name(path), r"(20\d{2})", 1)
    return F.coalesce(F.nullif(parent, F.lit("")), F.nullif(named, F.lit("")), F.lit("unknown"))


def custom_id(year: Column, name: Column, key: Column) -> Column:
    """year_stem_hash, the same for the same key."""
    return F.concat_ws("_", year.cast("string"), name, F.substring(F.sha2(key.cast("string"), 256), 1, 8))


def year_of_custom_id(value: Column) -> Column:
    """The part before the first underscore, if there are two parts."""
    parts = F.split(value, "_")
    return F.when(F.size(parts) >= 2, parts[0])


def fill_template(template: str, text: Column) -> Column:
    """The template with its {input} replaced, literally."""
    return F.replace(F.lit(template), F.lit("{input}"), text)


def user_question(message: Column) -> Column:
    """The question of a chat message: action_input of an action object, data.action_input, data if it is a string, else the
    message as it is."""
    parsed = F.try_parse_json(message)
    direct = F.when(F.try_variant_get(parsed, "$.action", "string").isNotNull(), F.try_variant_get(parsed, "$.action_input", "string"))
    nested = F.try_variant_get(parsed, "$.data.action_input", "string")
    data = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.data", "variant")) == "STRING", F.try_variant_get(parsed, "$.data", "string"))
    return F.coalesce(direct, nested, data, message)


def agent_input(value: Column) -> Column:
    """What an agent was given, as text: the input of an object that has one, else the value as it is."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), "$.input", "string"), value)


def is_web(address: Column) -> Column:
    """Whether an address begins with http."""
    return F.coalesce(address.startswith("http"), F.lit(False))


def safe_key(key: Column) -> Column:
    """A key as an identifier: in backticks if it has a space, a hyphen or a dot."""
    return F.when(key.rlike(r"[ .-]"), F.concat(F.lit("`"), key, F.lit("`"))).otherwise(key)


def document_title(title: Column, path: Column) -> Column:
    """The title a document gives, else its file's name without extension."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), stem(path))


def iso(at: Column) -> Column:
    """A time as ISO 8601 text with microseconds where there are any."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def stamp(at: Column) -> Column:
    """A time as it goes into file names."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def title_of(reply: Column, conversation: Column) -> Column:
    """A conversation's title: the title of a JSON reply, else the reply without white space around it, else the conversation's id."""
    return F.coalesce(F.nullif(F.get_json_object(reply, "$.title"), F.lit("")), F.nullif(F.trim(reply), F.lit("")), conversation)


def dict_or_list(value: Column, name: str) -> Column:
    """The strings of a JSON value that is an array or an object with the array under `name`."""
    return F.coalesce(F.from_json(F.get_json_object(value, f"$.{name}"), "array<string>"), F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")))


def needs_ocr(pages: Column, first: int = 3, least: int = 100) -> Column:
    """Whether none of the first pages has more than `least` characters; null pages need it."""
    return F.coalesce(~F.exists(F.slice(pages, 1, first), lambda p: F.length(p) > least), F.lit(True))


def kind_of_bytes(content: Column) -> Column:
    """The extension that a file's first bytes tell."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", ".pdf").when(head == "504B0304", ".xlsx").otherwise("")


def indicators(text: Column) -> Column:
    """array<struct<kind, value>> of indicators in a text, by pattern."""
    plain = lambda p: re.sub(r"\\b$", "(?![A-Za-z0-9_])", re.sub(r"^\\b", "(?<![A-Za-z0-9_])", p))  # noqa: E731 - word boundaries of ASCII, also beside Chinese
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(plain(pattern)), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(*[found(kind, pattern) for kind, pattern in INDICATORS.items()])


#: Patterns of indicators; plain enough for any regular expression engine.
INDICATORS = {
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "cve": r"\bCVE-[0-9]{4}-[0-9]{4,7}\b",
    "url": r"\bh(?:tt|xx)ps?://[A-Za-z0-9._/-]+",
    "email": r"\b[A-Za-z0-9_][A-Za-z0-9._-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b",
    "md5": r"\b[0-9a-f]{32}\b",
    "sha1": r"\b[0-9a-f]{40}\b",
    "sha256": r"\b[0-9a-f]{64}\b",
}
