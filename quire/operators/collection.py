"""Collections of entries: loading, upserts, patches, deletions, counts. Jobs return the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entry_id():
    return F.concat(F.lit("doc_"), "document_id", F.lit("_chunk_"), "chunk_index")


def clean_metadata(df: DataFrame, col: str = "extra") -> DataFrame:
    """Keys without a value dropped; values are text already."""
    return df.withColumn(col, F.map_filter(col, lambda k, v: v.isNotNull()))


def collection_load(embedded: DataFrame, name: str) -> DataFrame:
    """Entries of a collection from embedded chunks; what is missing has its default."""
    return embedded.select(
        F.lit(name).alias("collection"),
        entry_id().alias("id"),
        F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"),
        F.coalesce("content", F.lit("")).alias("document"),
        F.coalesce("length", F.length(F.coalesce("content", F.lit("")))).alias("length"),
        F.coalesce("embedding_model", F.lit("unknown")).alias("embedding_model"),
    )


def collection_entries(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document, metadata) of catalog chunks; a chunk's own keys win over the catalog's."""
    rows = chunks.join(documents.select("document_id", "title"), "document_id")
    catalog = F.create_map(F.lit("document_id"), F.col("document_id").cast("string"), F.lit("title"), F.col("title"), F.lit("chunk_id"), F.col("chunk_id"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    own = F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rest = F.map_filter(catalog, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return clean_metadata(rows.select(entry_id().alias("id"), F.col("content").alias("document"), F.map_concat(rest, own).alias("extra")))


def upsert(existing: DataFrame, incoming: DataFrame, on_conflict: str = "replace", order: str = "position") -> DataFrame:
    """existing with incoming put in by id; of several incoming rows of an id the last by `order`. "ignore" keeps what is there."""
    last = incoming.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("nth = 1").drop("nth", order)
    if on_conflict == "ignore":
        return existing.unionByName(last.join(existing.select("id"), "id", "left_anti"))
    return existing.join(last.select("id"), "id", "left_anti").unionByName(last)


def get_by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def delete_by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def update_metadata(entries: DataFrame, patch: DataFrame) -> DataFrame:
    """entries with the keys of patch (id, changes) set, the others kept."""
    rows = entries.join(patch.select("id", "changes"), "id", "left")
    kept = F.map_filter("extra", lambda k, v: ~F.array_contains(F.map_keys("changes"), k))
    return rows.withColumn("extra", F.when(F.col("changes").isNull(), F.col("extra")).otherwise(F.map_concat(kept, "changes"))).drop("changes")


def collection_stats(entries: DataFrame, metric: str = "cosine") -> DataFrame:
    return entries.groupBy("collection").agg(F.count("*").alias("n")).withColumn("metric", F.lit(metric))


def peek(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.orderBy("id").limit(n)


def reset(entries: DataFrame, name: str) -> DataFrame:
    """All but one collection, which is left empty."""
    return entries.where(F.col("collection") != name)


def rebuild_entries(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries to write again: indexed chunks that have a vector."""
    some = chunks.where(F.col("indexed") & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return some.join(documents.select("document_id", "title"), "document_id").select(entry_id().alias("id"), "document_id", "title", "content", "embedding")
