"""The index from end to end: pages to markdown, chunks, vectors and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.chunkers import ChunkConfig
from quire.operators.chunking import chunk_documents, chunk_text_export, chunks_combined
from quire.operators.collection import entry_id
from quire.operators.layout import layout_elements, pages_to_markdown
from quire.operators.vectors import EmbedFn, embed, hash_embed
from quire.sources.files import read_chunk_json, read_markdown, write_chunk_text, write_embeddings


def build_index(pages: DataFrame, documents: DataFrame, cfg: ChunkConfig = ChunkConfig(), embed_fn: EmbedFn = hash_embed, name: str = "main") -> DataFrame:
    """Entries of a collection from raw pages (document_id, page_number, raw) and documents (document_id, title)."""
    texts = pages_to_markdown(layout_elements(pages)).withColumn("source_file", F.concat(F.lit("doc_"), "document_id", F.lit(".md")))
    chunks = embed(chunk_documents(texts, cfg), "content", embed_fn)
    rows = chunks.join(documents.select("document_id", "title"), "document_id")
    return rows.select(F.lit(name).alias("collection"), entry_id().alias("id"), "document_id", "chunk_index", "title", "page", F.col("content").alias("document"), "length", "embedding")


def chunk_path(spark: SparkSession, source: str, out: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunk markdown files; write the text export and the combined documents. Returns the chunks."""
    docs = read_markdown(spark, source).withColumn("document_id", F.xxhash64("source_file"))
    chunks = chunk_documents(docs, cfg)
    chunks.write.parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    write_chunk_text(chunk_text_export(chunks), f"{out}/text")
    chunks_combined(chunks).write.parquet(f"{out}/combined")
    return chunks


def embed_path(spark: SparkSession, source: str, out: str, embed_fn: EmbedFn = hash_embed, text_field: str = "content") -> DataFrame:
    """Embed chunk JSON files; returns the index of the vectors written."""
    return write_embeddings(embed(read_chunk_json(spark, source, text_field), "content", embed_fn), out)
