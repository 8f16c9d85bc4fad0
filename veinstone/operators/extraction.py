"""Entity extraction by a pluggable model: prompt, reply, XML, report graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veinstone.functions import text as ft
from veinstone.operators import xmlparse


def indicator_reply(text: Column) -> Column:
    """The deterministic stand-in for a model: every distinct indicator of the text as an entity, in Catalyst."""
    kind = lambda i: F.when(i["kind"] == "cve", "vul").otherwise("ioc")
    found = F.array_distinct(ft.indicators(text))
    entity = lambda i, n: F.concat(F.lit("<Entity>"), xmlparse.element("EntityId", F.concat(F.lit("entity_"), (n + 1).cast("string"))), xmlparse.element("EntityName", i["value"]), xmlparse.element("EntityType", kind(i)), xmlparse.element("EntitySubType", i["kind"]), F.lit("</Entity>"))
    return F.concat(F.lit("<Entitys>"), F.array_join(F.transform(found, entity), ""), F.lit("</Entitys>\n<Relationships></Relationships>"))


def extract(reports: DataFrame, template: str, text: str = "text", model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """reports with xml, graph and status. model: prompts to replies, batch by batch, in the workers; without one the stand-in
    answers. Null and blank texts are skipped before the model sees them; a reply without XML has status ERROR."""
    rows = reports.where(F.trim(text) != "").withColumn("_prompt", ft.fill_template(template, F.col(text)))
    reply = F.pandas_udf(model, StringType(), F.PandasUDFType.SCALAR)("_prompt") if model else indicator_reply(F.col(text))
    rows = rows.withColumn("_reply", reply)  # named, so that it is made once
    rows = rows.withColumn("xml", ft.xml_of_reply(F.col("_reply"))).withColumn("graph", xmlparse.parse_xml(F.col("xml")))
    return rows.withColumn("status", xmlparse.status_of(F.col("graph"))).drop("_prompt", "_reply")


def status_class(status: Column) -> Column:
    """The first of SUCCESS, SKIP, WARNING and ERROR that a status message holds, else OTHER."""
    out = F.lit("OTHER")
    for name in ("ERROR", "WARNING", "SKIP", "SUCCESS"):
        out = F.when(status.contains(name), name).otherwise(out)
    return out
