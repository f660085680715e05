"""Conversations: (session_id, seq, message_type, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import preview, strip


def conversation_history(messages: DataFrame) -> DataFrame:
    """Messages that aren't blank, numbered within their session."""
    some = messages.where(strip(F.col("content")) != "")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))


def get_or_create_sessions(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """sessions with the wanted session_ids that weren't there."""
    new = wanted.select("session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    return sessions.unionByName(new, allowMissingColumns=True)


def conversation_recency(messages: DataFrame) -> DataFrame:
    """Sessions with their last message, the latest first by `recency`.

    Only the distinct last places, as many as turns of the longest session, are ranked in one task.
    """
    last = messages.groupBy("session_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n_messages"))
    places = last.select(F.col("last_seq").alias("place")).distinct().withColumn("recency", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("place"))))
    return last.join(places, F.col("last_seq").eqNullSafe(F.col("place"))).drop("place")


def chunk_usage(bridge: DataFrame) -> DataFrame:
    """(document_id, chunk_index, used_in_messages) of (message_id, document_id, chunk_index)."""
    return bridge.distinct().groupBy("document_id", "chunk_index").agg(F.count("*").alias("used_in_messages"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def message_search(messages: DataFrame, kind: str, term: str) -> DataFrame:
    hit = (F.col("message_type") == kind) & F.lower("content").contains(term.lower())
    return messages.where(hit).select("session_id", "seq", preview(F.col("content"), 100).alias("preview"))
