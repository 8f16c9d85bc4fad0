"""Retrieval-augmented chat as DataFrames: context blocks, prompts, history, titles, event-stream frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The sentences of the context block.
HEADER, NONE, UNKNOWN = "以下是相关文档信息：\n\n", "没有找到相关文档。", "未知来源"


def context(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context, documents): numbered blocks of hits(query_id, rank, source, content) in order of rank; queries without
    hits get the sentence that nothing was found."""
    block = F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("] 来源: "), F.coalesce("source", F.lit(UNKNOWN)), F.lit("\n内容: "), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    by = hits.select("query_id", F.struct("rank", block.alias("b")).alias("r")).groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("all"))
    out = by.select("query_id", F.concat(F.lit(HEADER), F.array_join(F.transform("all", lambda r: r["b"]), "")).alias("context"), F.size("all").alias("documents"))
    if queries is None:
        return out
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NONE)).alias("context"), F.coalesce("documents", F.lit(0)).alias("documents"))


def gated(questions: DataFrame, use_rag: str, database: bool = True) -> DataFrame:
    """questions with retrieve: whether retrieval runs for one, that is, its column `use_rag` is true and there is a database."""
    return questions.withColumn("retrieve", F.coalesce(F.col(use_rag), F.lit(False)) & F.lit(database))


def gated_context(questions: DataFrame, hits: DataFrame, use_rag: str = "use_rag", database: bool = True) -> DataFrame:
    """(query_id, context, documents): like `context` for questions that retrieve, an empty context for the others."""
    asked = gated(questions, use_rag, database)
    found = context(hits, asked.where("retrieve").select("query_id"))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("documents", F.lit(0)).alias("documents"))


def retrieval_answer(questions: DataFrame, hits: DataFrame, model=None) -> DataFrame:
    """(query_id, prompt, answer) of questions(query_id, question) with all their hits put into one prompt."""
    rows = questions.join(context(hits, questions), "query_id")
    return answer(rows.select("query_id", prompt(F.lit(""), F.col("context"), F.col("question")).alias("prompt")), model)


def compare_arms(one: DataFrame, other: DataFrame, names: tuple[str, str] = ("text_only", "graph_enhanced")) -> DataFrame:
    """Two tables of metrics (query_id, score) side by side by query, with the difference; a query that one lacks has null there."""
    left, right = (rows.select("query_id", F.col("score").alias(name)) for rows, name in zip((one, other), names))
    return left.join(right, "query_id", "full").withColumn("gain", F.col(names[1]) - F.col(names[0]))


def history(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with the earlier turns of the conversation as lines `role: text`."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


def prompt(history_: Column, context_: Column, question: Column) -> Column:
    """The chat prompt: history, context, question."""
    return F.concat(F.lit("History:\n"), history_, F.lit("\n\nContext:\n"), context_, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def token_json(token: Column) -> Column:
    return F.to_json(F.struct(F.lit("conversation").alias("type"), token.alias("data")))


def error_frame(message: Column) -> Column:
    """The frame that ends a stream which failed."""
    return F.concat(F.lit("event: error\ndata: "), F.to_json(F.struct(message.alias("error"))), F.lit("\n\n"))


def frames(conversation: Column, context_: Column, tokens: Column, title: Column) -> Column:
    """The event-stream frames of an answer in order: conversation id, context, one per token that is not empty, title, and the
    complete text; each ends with a blank line."""
    frame = lambda head, body: F.concat(F.lit(head), body, F.lit("\n\n"))
    said = F.filter(tokens, lambda t: F.length(t) > 0)
    whole = F.concat(F.lit("event: complete\ndata: "), F.to_json(F.struct(conversation.alias("conversation_id"), F.array_join(said, "").alias("text"))), F.lit("\n\n"))
    return F.concat(F.array(frame("data:[conversation_id]:", conversation), frame("data: [rag_context]:", context_)), F.transform(said, lambda t: frame("data: ", t)), F.array(frame("data:[conversation_title]:", title), whole))


def answer(prompts: DataFrame, model=None) -> DataFrame:
    """prompts(query_id, prompt) with an answer of `model`, a function from a pandas Series to one, run in batches; without a model a
    deterministic stand-in that returns the last line of the prompt's context."""
    def stand_in(texts: pd.Series) -> pd.Series:
        return texts.str.extract(r"(?s)Context:\n(.*?)\n\nQuestion", expand=False).fillna("").str.strip().str.split("\n").str[-1]

    return prompts.withColumn("answer", F.pandas_udf(model or stand_in, StringType(), F.PandasUDFType.SCALAR)("prompt"))
