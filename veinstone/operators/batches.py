"""Batch inference files: requests out, replies in, both with line-level accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions import text as ft

REQUEST = "custom_id string, method string, url string, body struct<model: string, messages: array<struct<role: string, content: string>>, temperature: double, max_tokens: int>"
_CHOICES = "array<struct<message: struct<content: string>>>"
RESPONSE = f"custom_id string, response struct<body: struct<choices: {_CHOICES}>, choices: {_CHOICES}>, _corrupt_record string"


def request_line(custom_id: Column, system: str, template: str, text: Column, model: str, temperature: float = 0.2, max_tokens: int = 4096) -> Column:
    """One JSON request for a text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", ft.fill_template(template, text))).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def is_request(line: Column) -> Column:
    """Whether a line is a JSON request with all its keys."""
    r = F.from_json(line, REQUEST)
    return F.coalesce(r["custom_id"].isNotNull() & r["method"].isNotNull() & r["url"].isNotNull() & r["body"]["model"].isNotNull() & r["body"]["messages"].isNotNull(), F.lit(False))


def first_content(response: Column) -> Column:
    """The content of the first choice, in either layout."""
    return F.coalesce(F.get(response["body"]["choices"], F.lit(0))["message"]["content"], F.get(response["choices"], F.lit(0))["message"]["content"])


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(response_id, custom_id, response) with year, content, xml and status: SUCCESS, NO_CHOICES, EMPTY or BAD_ID."""
    choices = F.coalesce(F.size("response.body.choices"), F.lit(-1)) + F.coalesce(F.size("response.choices"), F.lit(-1))
    content = first_content(F.col("response"))
    rows = replies.select("response_id", "custom_id", ft.year_of_custom_id(F.col("custom_id")).alias("year"), content.alias("content"), (choices > -1).alias("any"))
    status = F.when(~F.col("any"), "NO_CHOICES").when(F.coalesce(F.trim("content"), F.lit("")) == "", "EMPTY").when(F.col("year").isNull(), "BAD_ID").otherwise("SUCCESS")
    return rows.select("response_id", "custom_id", "year", "content", ft.xml_of_reply(F.col("content")).alias("xml"), status.alias("status"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, custom_id, content, ok) of reply lines(line_no, value); a line without id is named unknown_<line_no>; broken lines
    are kept with ok false."""
    r = F.from_json("value", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("r", r)
    ok = F.coalesce(F.col("r._corrupt_record").isNull(), F.lit(False)) & F.col("value").rlike(r"^\s*\{")
    return rows.select("line_no", F.coalesce("r.custom_id", F.concat(F.lit("unknown_"), F.col("line_no").cast("string"))).alias("custom_id"), first_content(F.col("r.response")).alias("content"), ok.alias("ok"))


def line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: all lines, valid requests, invalid ones."""
    valid = is_request(F.col(column))
    return lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))


def run_stats(rows: DataFrame, status: str = "status", success: str = "SUCCESS", skipped: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """One row: total, succeeded, failed, success_rate in percent (null for no rows); with `skipped`, statuses that are neither, also
    their number, and with `size` the summed octets of that column."""
    done, idle = F.count_if(F.col(status) == success), F.count_if(F.col(status).isin(*skipped)) if skipped else F.lit(0)
    total = F.count(F.lit(1))
    more = ([idle.alias("skipped")] if skipped else []) + ([F.sum(F.octet_length(size)).alias("octets")] if size else [])
    return rows.agg(total.alias("total"), done.alias("succeeded"), (total - done - idle).alias("failed"), F.round(100.0 * done / F.nullif(total, F.lit(0)), 2).alias("success_rate"), *more)
