"""Progress of documents while their processing logs stream in: keyed state, one row for each document that changed.

Logs are (document_id, log_id, stage, level, message, created_at). The state of a document is its last and its first
erroneous step, by time and number, so rows may come in any order. It is given up when the document is done and
nothing has come for a while of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.catalog import pipeline_state

#: Per cent at the begin and at the end of each stage. Fixed values.
PER_CENT = {"parsing": (10, 30), "chunking": (35, 50), "embedding": (55, 75), "indexing": (80, 100)}
LAST = "indexing"
ROWS = "document_id long, stage string, level string, first_error string, seen_at timestamp, seen_id long"
STATE = "stage string, level string, seen_at timestamp, seen_id long, first_error string, error_at timestamp, error_id long"


def percent(stage: Column, level: Column) -> Column:
    """A stage's end if its last step succeeded, else its begin; 0 for others."""
    out = F.lit(0)
    for name, (begin, end) in PER_CENT.items():
        out = F.when(stage == name, F.when(level == "success", end).otherwise(begin)).otherwise(out)
    return out


def pipeline_progress(logs: DataFrame) -> DataFrame:
    """The last stage and level of each document, its first error and per cent: what the stream comes to."""
    return pipeline_state(logs).withColumn("percent", percent(F.col("stage"), F.col("level")))


def progress(logs: DataFrame, late: str = "1 hour", idle_s: int = 24 * 3600) -> DataFrame:
    """A stream of (document_id, stage, level, first_error, seen_at, seen_id), one row for each change of a document."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, level, at, number, error, error_at, error_id = state.get if state.exists else (None,) * 7
        for batch in batches:
            for row in batch.itertuples(index=False):
                place = (row.created_at, row.log_id)
                if at is None or place >= (at, number):
                    (at, number), stage, level = place, row.stage, row.level
                if row.level == "error" and (error_at is None or place < (error_at, error_id)):
                    (error_at, error_id), error = place, row.message
        state.update((stage, level, at, number, error, error_at, error_id))
        ended = stage == LAST and level == "success"
        wait = int(at.timestamp() * 1000) + idle_s * 1000
        if ended and wait > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(wait)
        yield pd.DataFrame([(key[0], stage, level, error, at, number)], columns=["document_id", "stage", "level", "first_error", "seen_at", "seen_id"])

    rows = logs.select("document_id", "log_id", "stage", "level", "message", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late)
    return rows.groupBy("document_id").applyInPandasWithState(fold, ROWS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def progress_stream(logs: DataFrame, out: str, checkpoint: str, late: str = "1 hour", idle_s: int = 24 * 3600) -> StreamingQuery:
    """Start a query over all logs that are there; a batch that runs again writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return progress(logs, late, idle_s).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """The state of each document after all batches, with per cent."""
    every = spark.read.schema(f"{ROWS}, batch int").parquet(out)
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("batch")))
    last = every.withColumn("nth", newest).where("nth = 1")
    return last.select("document_id", "stage", "level", "first_error", percent(F.col("stage"), F.col("level")).alias("percent"))
