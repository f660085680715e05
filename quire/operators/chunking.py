"""Documents to chunks, and what is told about chunks.

Chunks are (document_id, chunk_index, chunk_id, content, length, page, section_title, strategy, start_pos, end_pos,
source_file, total_chunks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.chunkers import CHUNKERS, ChunkConfig, Piece, pack
from quire.functions.text import newlines, ordered_join, preview, strip, word_count

CHUNK_SCHEMA = "document_id long, chunk_index int, chunk_id string, content string, length int, page int, section_title string, strategy string, start_pos int, end_pos int, source_file string, total_chunks int"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Chunks and characters of chunks that a task hands on at once, whatever the number and length of its texts.
BATCH_ROWS, BATCH_CHARS = 1_000, 1_000_000


def chunk_documents(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), chunk_fn: Callable[[str, ChunkConfig], Iterator[Piece]] | None = None) -> DataFrame:
    """Chunks of docs (document_id, source_file, markdown). A document is cut where it is read, without a shuffle.

    Line ends are made \\n first. Null or empty text: no chunks. chunk_fn replaces the configured strategy.
    """
    cut = chunk_fn or CHUNKERS[cfg.kind]
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in CHUNK_SCHEMA.split(", "))])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time is a string, the others stay in their batch
                doc, name, text = (batch.column(c)[row].as_py() for c in ("document_id", "source_file", "markdown"))
                pieces = list(cut(text, cfg)) if text else []
                for k, p in enumerate(pieces):
                    out.append((doc, k, f"chunk_{k:04d}", p.content, len(p.content), p.page, p.title, p.strategy, p.start, p.end, name, len(pieces)))
                    held += len(p.content)
                    if held >= BATCH_CHARS or len(out) >= BATCH_ROWS:
                        yield made(out)
                        out, held = [], 0
        if out:
            yield made(out)

    return docs.select(F.col("document_id").cast("long").alias("document_id"), "source_file", newlines(F.col("markdown")).alias("markdown")).mapInArrow(rows, CHUNK_SCHEMA)


def sections(docs: DataFrame) -> DataFrame:
    """(document_id, section, title, body): parts at headings of level two and deeper, by columns alone."""
    lines = docs.select("document_id", F.posexplode(F.split(newlines(F.col("markdown")), "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^#{2,}\s+(.+)$", 1)
    order = Window.partitionBy("document_id").orderBy("pos")
    marked = lines.withColumn("head", head).withColumn("section", F.sum((F.col("head") != "").cast("int")).over(order))
    grouped = marked.groupBy("document_id", "section").agg(F.max(F.when(F.col("head") != "", F.col("head"))).alias("title"), F.concat(ordered_join(F.col("pos"), F.col("line"), "\n"), F.lit("\n")).alias("body"))
    return grouped.where(strip(F.col("body")) != "").select("document_id", F.col("section").cast("int").alias("section"), "title", "body")


def pack_paragraphs(parts: DataFrame, size: int, overlap: int) -> DataFrame:
    """parts (document_id, section, body) with each body packed into pieces (piece, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, s, k, p) for d, s, body in zip(b["document_id"], b["section"], b["body"]) for k, p in enumerate(pack(body, size, overlap))]
            yield pd.DataFrame(out, columns=["document_id", "section", "piece", "content"])

    return parts.select("document_id", "section", "body").mapInPandas(rows, "document_id long, section int, piece int, content string")


def is_table(c: Column) -> Column:
    """A markdown or LaTeX table of two lines or more: among the first three a rule with a pipe at either end."""
    lines = F.split(strip(c), "\n")
    rule = F.exists(F.slice(lines, 1, 3), lambda x: strip(x).rlike(r"^\|[\s:|-]+\|$"))
    return (F.size(lines) >= 2) & (rule | c.contains("\\begin{tabular}") | c.contains("\\end{tabular}"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.col("length")
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_length"))


def strategy_dist(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("strategy").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def chunks_per_page(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id", "page").agg(F.count("*").alias("n"))


def chunk_extremes(chunks: DataFrame) -> DataFrame:
    """The longest chunk of each document, and the shortest of over 100 characters; the first of equals."""
    key = F.struct(-F.col("length"), "chunk_index")
    short = F.when(F.col("length") > 100, F.struct("length", "chunk_index"))
    return chunks.groupBy("document_id").agg(F.min_by("chunk_index", key).alias("longest"), F.min_by("chunk_index", short).alias("shortest"))


def chunk_filters(chunks: DataFrame, word: str) -> DataFrame:
    hits = {
        "on_first_page": F.col("page") == 1,
        "with_word": F.lower("content").contains(word.lower()),
        "long": F.col("length") > 1000,
        "titled": F.col("section_title").isNotNull(),
        "tabular": F.col("content").contains("|") & F.col("content").contains("---"),
    }
    return chunks.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in hits.items()])


def chunk_features(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "chunk_index", word_count(F.col("content")).alias("n_words"), F.col("content").contains("$").alias("has_formula"))


def embedding_export(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat(F.lit("doc_chunk_"), "chunk_index").alias("id"), F.col("content").alias("text"), "page", F.col("section_title").alias("section"), F.col("source_file").alias("source"))


def chunk_preview(chunks: DataFrame, n: int = 100) -> DataFrame:
    return chunks.select("document_id", "chunk_index", preview(F.col("content"), n).alias("preview"))


def chunk_text_export(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, value): a chunk's text file with its comment lines."""
    meta = F.concat(F.lit("page="), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(", strategy="), "strategy")
    head = F.concat(F.lit("<!-- Chunk ID: "), "chunk_index", F.lit(" -->\n<!-- Metadata: "), meta, F.lit(" -->\n\n"))
    return chunks.select("document_id", "chunk_index", F.concat(head, "content").alias("value"))


def chunks_combined(chunks: DataFrame) -> DataFrame:
    """(document_id, combined): all chunks of a document in one text, in order."""
    line = "=" * 80
    block = F.concat(F.lit("Chunk "), "chunk_index", F.lit("\nStrategy: "), "strategy", F.lit("\nLength: "), "length", F.lit("\n\n"), "content", F.lit(f"\n\n{line}\n"))
    docs = chunks.groupBy("document_id").agg(ordered_join(F.col("chunk_index"), block, "").alias("body"), F.count("*").alias("n"))
    return docs.select("document_id", F.concat(F.lit("Document "), "document_id", F.lit("\nTotal chunks: "), "n", F.lit(f"\n{line}\n"), "body").alias("combined"))
