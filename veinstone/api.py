"""Python entry points for programs that embed the engine: parsers, a vector index, tools, a chat turn, a listener of streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veinstone.operators import rag, vector


class Parser(Protocol):
    """What turns a column of raw contents into a column of parsed ones."""

    def parse(self, content: Column) -> Column: ...


class PageParser:
    """HTML pages to struct<title, content>."""

    def parse(self, content: Column) -> Column:
        from veinstone.functions.html import page

        return page(content)


class XmlParser:
    """Extraction XML, repaired, to report graphs."""

    def parse(self, content: Column) -> Column:
        from veinstone.operators.xmlparse import parse_xml
        from veinstone.operators.xmlrepair import repaired

        return parse_xml(repaired(content))


class VectorIndex:
    """An inverted-list index at a path: loaded if it is there, else built over base(id, vector) and saved."""

    def __init__(self, spark: SparkSession, path: str, base: DataFrame | None = None, lists: int | None = None) -> None:
        found = vector.load_index(spark, path)
        if found is None:
            if base is None:
                raise FileNotFoundError(f"there is no index at {path} and nothing to build one from")
            found = vector.load_or_build(base, path, lists)
        self.rows, self.centroids = found
        self.probe = vector.fit_probe(self.rows.select("id", "vector"), self.rows, self.centroids)

    def search(self, queries: DataFrame, k: int = 5, at_least: float | None = None) -> DataFrame:
        """(query_id, id, score, rank) of the nearest by inner product."""
        found = vector.search_lists(queries, self.rows, self.centroids, k, self.probe)
        return found if at_least is None else found.where(F.col("score") >= at_least)


@dataclass(frozen=True)
class Tool:
    """A named function over DataFrames that an agent may call."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    description: str


def chat(questions: DataFrame, index: VectorIndex, documents: DataFrame, embed: Callable[[Column], Column], model=None, k: int = 5, use_rag: bool = True) -> DataFrame:
    """(query_id, context, prompt, answer) of questions(query_id, question, history): the question embedded, its k nearest of
    documents(id, source, content) put into the context, the prompt answered by `model` (a stand-in without one)."""
    if use_rag:
        hits = index.search(questions.select("query_id", embed(F.col("question")).alias("vector")), k).join(documents, "id")
        found = rag.context(hits.select("query_id", "rank", "source", "content"), questions)
    else:
        found = questions.select("query_id", F.lit("").alias("context"))
    rows = questions.join(found.select("query_id", "context"), "query_id")
    rows = rows.select("query_id", "context", rag.prompt(F.coalesce("history", F.lit("")), F.col("context"), F.col("question")).alias("prompt"))
    return rag.answer(rows, model)


class Progress(StreamingQueryListener):
    """Hands the progress of each micro-batch, and the end of each stream, to functions."""

    def __init__(self, on_batch: Callable[[dict], None], on_end: Callable[[str, str | None], None] = lambda *_: None) -> None:
        self.on_batch, self.on_end = on_batch, on_end

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.on_batch({"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_end(str(event.id), event.exception)
