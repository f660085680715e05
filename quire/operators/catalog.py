"""Reports over the catalog, and its changes as jobs from tables to tables.

documents (document_id, title, status, created_at, started_at, completed_at, ...); children carry document_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.collection import entry_id

PDF, IMAGES = (".pdf",), (".png", ".jpg", ".jpeg", ".tiff", ".bmp")


def route_files(files: DataFrame) -> DataFrame:
    """Where a file goes by its suffix: pdf, image or error."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.select("path", F.when(suffix.isin(*PDF), "pdf").when(suffix.isin(*IMAGES), "image").otherwise("error").alias("route"))


def default_title(title: Column, filename: Column) -> Column:
    return F.when(F.coalesce(strip(title), F.lit("")) == "", F.regexp_replace(filename, r"\.[^.]*$", "")).otherwise(title)


def dashboard(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    status = F.col("status")
    d = documents.agg(F.count("*").alias("n_documents"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"), F.count_if(~status.isin("completed", "failed")).alias("processing"))
    return d.crossJoin(chunks.agg(F.count("*").alias("n_chunks"), F.count_if("indexed").alias("n_indexed")))  # one row by one row


def recent_documents(documents: DataFrame, n: int = 10) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), F.desc("document_id")).limit(n)


def recent_logs(logs: DataFrame, n: int = 20) -> DataFrame:
    """The newest logs."""
    return logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)


def document_counts(documents: DataFrame, children: dict[str, DataFrame], statuses: list[str] | None = None) -> DataFrame:
    """Documents with the number of each kind of children, each counted before it is joined."""
    out = documents.where(F.col("status").isin(*statuses)) if statuses else documents
    for name, df in children.items():
        counted = df.groupBy("document_id").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counted, "document_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def stage_totals(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Documents with total_<kind> of each kind of children, 0 without any; a total that was there is replaced.

    Children are counted where they are read, before counts move.
    """
    kept = documents.drop(*[f"total_{name}" for name in children])
    counted = None
    for name, df in children.items():
        one = df.groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", F.lit(name).alias("kind"), "n")
        counted = one if counted is None else counted.unionByName(one)
    totals = counted.groupBy("document_id").agg(*[F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(f"total_{name}") for name in children])
    out = kept.join(totals, "document_id", "left")
    return out.withColumns({f"total_{name}": F.coalesce(f"total_{name}", F.lit(0)) for name in children})


def first_of_each(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each document."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).where(F.col("nth") <= n)


def document_status(documents: DataFrame, logs: DataFrame, n: int = 5) -> DataFrame:
    """Documents with their newest log messages, the newest first."""
    newest = first_of_each(logs, n, F.desc("created_at"), F.desc("log_id"))
    told = newest.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("nth", "message"))).alias("m"))
    return documents.join(told, "document_id", "left").withColumn("messages", F.coalesce(F.array_join(F.transform("m", lambda x: x["message"]), " | "), F.lit(""))).drop("m")


def chunk_detail(chunks: DataFrame, documents: DataFrame, document_id: int, chunk_index: int) -> DataFrame:
    return chunks.where((F.col("document_id") == document_id) & (F.col("chunk_index") == chunk_index)).join(documents.select("document_id", "title"), "document_id")


def processing_time(documents: DataFrame) -> DataFrame:
    """Seconds from start to completion, null if either is unknown."""
    return documents.withColumn("seconds", (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6)


def has_content(documents: DataFrame, children: list[DataFrame]) -> DataFrame:
    some = None
    for df in children:
        ids = df.select("document_id")
        some = ids if some is None else some.union(ids)
    found = some.distinct().withColumn("has_content", F.lit(True))
    return documents.select("document_id").join(found, "document_id", "left").withColumn("has_content", F.coalesce("has_content", F.lit(False)))


def indexed_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if("indexed").alias("n_indexed"))


def health_flags(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.agg(F.count_if(F.col("status") != "completed").alias("n_pending"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_if("indexed").alias("n_indexed"))
    flag = F.when((F.col("n_chunks") > 0) & (F.col("n_indexed") == 0), "warning").when((F.col("n_pending") == 0) & (F.col("n_chunks") == F.col("n_indexed")), "good").otherwise("pending")
    return d.crossJoin(c).withColumn("flag", flag)  # one row by one row


def index_consistency(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(side, id): ids that only the catalog's indexed chunks have, or only the collection."""
    ids = chunks.where("indexed").select(entry_id().alias("id"))
    only = lambda a, b, name: a.join(b.select("id"), "id", "left_anti").select(F.lit(name).alias("side"), "id")
    return only(ids, entries, "catalog").unionByName(only(entries.select("id"), ids, "collection"))


def page_assets(pages: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    key = ["document_id", "page_number"]
    out = pages.select(*key, F.length("raw").alias("n_chars"))
    for name, df in (("images", images), ("tables", tables)):
        out = out.join(df.groupBy(*key).agg(F.count("*").alias(f"n_{name}")), key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def admin_search(df: DataFrame, fields: list[str], term: str, **equal) -> DataFrame:
    """Rows of which a field has the term, whatever the case, and whose other columns have the given values."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(term.lower()), F.lit(False))
    for name, value in equal.items():
        hit = hit & (F.col(name) == value)
    return df.where(hit)


def cascade_delete(tables: dict[str, DataFrame], entries: DataFrame, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the documents of ids (document_id), and the collection without their entries."""
    gone = ids.select("document_id").distinct()
    left = {name: df.join(gone, "document_id", "left_anti") for name, df in tables.items()}
    return left, entries.join(tables["chunks"].join(gone, "document_id", "left_semi").select(entry_id().alias("id")), "id", "left_anti")


def reprocess_reset(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of ids set back to uploaded, without times or progress."""
    chosen = ids.select("document_id", F.lit(True).alias("reset")).distinct()
    rows = documents.join(chosen, "document_id", "left").withColumn("reset", F.coalesce("reset", F.lit(False)))
    return rows.withColumns({"status": F.when(F.col("reset"), "uploaded").otherwise(F.col("status")), "started_at": F.when(~F.col("reset"), F.col("started_at")), "completed_at": F.when(~F.col("reset"), F.col("completed_at"))}).drop("reset")


def reindex_reset(documents: DataFrame) -> DataFrame:
    """Completed documents, ready to be indexed again."""
    return documents.where("status = 'completed'").withColumns({"status": F.lit("uploaded"), "indexing_done": F.lit(False)})


def mark_unindexed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"indexed": F.lit(False), "external_id": F.lit(None).cast("string")})


def mark_indexed(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """Chunks whose entries were written, marked and with the entry's id."""
    ids = written.select("id", F.lit(True).alias("w")).distinct()
    rows = chunks.withColumn("id", entry_id()).join(ids, "id", "left")
    return rows.withColumns({"indexed": F.col("indexed") | F.coalesce("w", F.lit(False)), "external_id": F.when(F.col("w"), F.col("id"))}).drop("id", "w")


def pipeline_state(logs: DataFrame) -> DataFrame:
    """The last stage, level and message of each document, and its first error."""
    at = F.struct("created_at", "log_id")
    return logs.groupBy("document_id").agg(F.max_by("stage", at).alias("stage"), F.max_by("level", at).alias("level"), F.min_by("message", F.when(F.col("level") == "error", at)).alias("first_error"))


def log_report(logs: DataFrame) -> DataFrame:
    return logs.groupBy("stage", "level").agg(F.count("*").alias("n"))
