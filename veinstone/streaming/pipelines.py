"""Structured Streaming: file ingestion to a chunk table, token streams, conversation state, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veinstone.functions import chunk


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, key: str, text: str, size: int = 3000, overlap: int = 1000, poll: str | None = None, files: int = 10) -> StreamingQuery:
    """New Parquet files of `source` to chunks in `target`, each file exactly once: the checkpoint is the manifest. poll: a
    processing-time interval such as "60 seconds"; None takes what is there and ends."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).where(F.col(text).isNotNull())
    chunks = rows.select(F.col(key), F.explode(chunk.windows(F.col(text), size, overlap)).alias("c")).select(key, "c.chunk_no", "c.content")
    writer = chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def stop(query: StreamingQuery, wait: int = 2) -> bool:
    """End a query and wait for it, at most `wait` seconds; whether it ended."""
    query.stop()
    return bool(query.awaitTermination(wait))


def windows(events: DataFrame, kind: str = "tumbling", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type: tumbling (1 hour), sliding (1 hour by 15 minutes), or session (30 minutes
    apart, by user). Works on streams, with a watermark, and on tables."""
    plain = dict(events.dtypes)["ts"] == "timestamp_ntz"  # a watermark needs an instant; times without zone are the session's
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    of = {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "15 minutes"), "session": F.session_window("ts", "30 minutes")}[kind]
    by = "user_id" if kind == "session" else "event_type"
    out = rows.groupBy(of.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    at = lambda c: F.col(f"w.{c}").cast("timestamp_ntz" if plain else "timestamp").alias(c)
    return out.select(at("start"), at("end"), by, "n", F.round("total", 6).alias("total"))


def token_answers(tokens: DataFrame) -> DataFrame:
    """(conv_id, answer) of tokens(conv_id, seq, token) in order, empty ones left out."""
    kept = tokens.where(F.length("token") > 0).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "token"))).alias("all"))
    return kept.select("conv_id", F.array_join(F.transform("all", lambda t: t["token"]), "").alias("answer"))


def conversation_turns(messages: DataFrame, idle: str = "1 hour") -> DataFrame:
    """(conv_id, turn, text) of a stream of messages(conv_id, ts, text): turns are numbered per conversation in state that lasts
    across batches and is dropped when the conversation has been idle."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        for batch in batches:
            batch = batch.sort_values("ts")
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": range(seen, seen + len(batch)), "text": batch["text"]})
            seen += len(batch)
        state.update((seen,))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))

    return messages.groupBy("conv_id").applyInPandasWithState(number, "conv_id string, turn long, text string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ensure_conversation(given: str, known: str | None = None):
    """Column: the conversation id that is given, else a new one."""
    return F.coalesce(F.nullif(F.col(given), F.lit("")), F.uuid() if known is None else F.col(known))
