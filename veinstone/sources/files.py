"""Readers of files: report trees, documents of many formats, line files, indicator lists, report graphs. Files without a byte give
no row."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veinstone.functions import text as ft

GRAPH = (
    "Entities array<struct<EntityId: string, EntityName: string, EntityType: string, EntitySubType: string, EntityVariantNames: array<string>, Labels: array<string>, Times: array<string>, Properties: map<string,string>>>, "
    "Relationships array<struct<RelationshipId: string, RelationshipType: string, Source: string, Target: string>>"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def report_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, year, name, text) of <path>/<year>/<name>.txt; directories that are no number are left out."""
    rows = _binary(spark, path, "*.txt").select("path", F.element_at(F.split("path", "/"), -2).alias("year"), ft.stem(F.col("path")).alias("name"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(F.col("year").rlike("^[0-9]+$")).withColumn("year", F.col("year").cast("int"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, size) of a directory, without reading contents."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(ft.base_name(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


@F.pandas_udf(StringType())
def _docx(contents: pd.Series) -> pd.Series:
    def read(content: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))

    return contents.map(read, na_action="ignore")


@F.pandas_udf(StringType())
def _pdf(contents: pd.Series) -> pd.Series:
    try:
        from pypdf import PdfReader
    except ImportError:  # the reader is optional; without it PDF files have a null text
        return pd.Series([None] * len(contents), dtype="object")

    def read(content: bytes) -> str | None:
        try:
            return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
        except Exception:  # noqa: BLE001 - a broken file must not end the scan
            return None

    return contents.map(read, na_action="ignore")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, kind, page_content) of all .txt, .json, .docx and .pdf files below path; a file that can't be read has null content."""
    rows = _binary(spark, path, "*.{txt,json,docx,pdf,TXT,JSON,DOCX,PDF}").select("path", "content", ft.extension(F.col("path")).alias("kind"))
    content = F.when(F.col("kind").isin(".txt", ".json"), F.decode("content", "UTF-8")).when(F.col("kind") == ".docx", _docx("content")).when(F.col("kind") == ".pdf", _pdf("content"))
    return rows.select(ft.base_name(F.col("path")).alias("source"), "kind", content.alias("page_content"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, seq, page_content) of all .json files below path: a document per element of an array, one for any other value, as JSON
    text, a string as it is; a broken file gives none."""
    rows = _binary(spark, path, "*.{json,JSON}").select(ft.base_name(F.col("path")).alias("source"), F.try_parse_json(F.decode("content", "UTF-8")).alias("v")).where("v is not null")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = rows.select("source", F.posexplode(items).alias("seq", "v"))
    return rows.select("source", "seq", F.coalesce(F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")), F.to_json("v")).alias("page_content"))


def pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, year, page_content) of all .pdf files below path, pages in order; without a PDF reader the content is null."""
    rows = _binary(spark, path, "*.{pdf,PDF}")
    return rows.select(ft.base_name(F.col("path")).alias("source"), ft.scan_year(F.col("path")).alias("year"), _pdf("content").alias("page_content"))


def template(spark: SparkSession, path: str) -> str:
    """A prompt template; it must hold {input}."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if "{input}" not in text:
        raise ValueError(f"{path} has no {{input}}")
    return text


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a file of `key: value` or `KEY=value` lines; sections indent their keys, which are joined to them by dots. Lines that
    are blank or begin with # say nothing; quotes around a value are dropped."""
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for line in (x for r in spark.read.text(path, wholetext=True).collect() for x in r[0].splitlines()):
        match = re.match(r"^(\s*)(?:export\s+)?([\w.-]+)\s*[:=]\s*(.*?)\s*$", line)
        if not match or line.lstrip().startswith("#"):
            continue
        depth, key, value = len(match[1]), match[2], re.sub(r"\s+#.*$", "", match[3])
        above = [a for a in above if a[0] < depth]
        if value:
            out[".".join([*(k for _, k in above), key])] = value.strip("\"'")
        else:
            above.append((depth, key))
    return out


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a JSON array of names; a broken file gives none."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "array<string>")).alias("file")).distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line that is not blank, stripped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSONL file with _corrupt_record for lines that are none."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines(spark, path).select(parsed.alias("r"), "value").select("r.*", "value")


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, year, name, xml) of all .xml files below path."""
    rows = _binary(spark, path, "*.xml")
    return rows.select("path", ft.year_of_path(F.col("path")).alias("year"), ft.stem(F.col("path")).alias("name"), F.decode("content", "UTF-8").alias("xml"))


def graph_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, Entities, Relationships) of all .json report graphs below path."""
    rows = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "Entities", "Relationships")


def indicator_list(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value) of two-column CSV files without header; a byte order mark is stripped, repeats fall together."""
    rows = spark.read.schema("kind string, value string").csv(path)
    return rows.select(F.regexp_replace("kind", "^﻿", "").alias("kind"), F.trim("value").alias("value")).where("value is not null").distinct()


def report_index(spark: SparkSession, path: str) -> DataFrame:
    """The report index, newest entry first (the file's order reversed is its position descending)."""
    schema = "array<struct<Date: string, Title: string, Year: string, Source: string, Link: string, Filename: string, `SHA-1`: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("pos", "r"))
    return rows.select("pos", "r.*").orderBy(F.desc("pos"))


def key_values(text_lines: DataFrame, column: str = "value") -> DataFrame:
    """text_lines with ns, key and item of lines `<ns>.<key>: '<value>'`; other lines have nulls."""
    part = lambda n: F.nullif(F.regexp_extract(column, r"^\s*([a-z]+)\.([A-Za-z_]+):\s*'(.*)'\s*$", n), F.lit(""))
    return text_lines.withColumn("ns", part(1)).withColumn("key", part(2)).withColumn("item", part(3))
