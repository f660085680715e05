"""Incremental ingest: new markdown files to chunks, vectors and entries.

Stateless and idempotent by id, so no watermark: a batch that runs again writes the same entries to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.chunkers import ChunkConfig
from quire.functions.text import newlines
from quire.operators.chunking import chunk_documents
from quire.operators.collection import entry_id
from quire.operators.vectors import EmbedFn, embed, hash_embed


def ingest_stream(spark: SparkSession, source: str, out: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), embed_fn: EmbedFn = hash_embed) -> StreamingQuery:
    """Start a query over the markdown files of a folder that ends when all that is there is read."""
    files = spark.readStream.format("text").option("wholetext", True).load(source)
    docs = files.select(F.xxhash64("_metadata.file_name").alias("document_id"), F.col("_metadata.file_name").alias("source_file"), newlines(F.col("value")).alias("markdown"))

    def write(batch: DataFrame, number: int) -> None:
        entries = embed(chunk_documents(batch, cfg), "content", embed_fn).withColumn("id", entry_id())
        entries.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_entries(spark: SparkSession, out: str) -> DataFrame:
    """Entries of all batches; of an id that several have, the last batch's."""
    every = spark.read.parquet(out)
    last = every.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["document_id", "batch"]).drop("batch")
