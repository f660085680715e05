"""Readers and writers of the file formats: markdown, raw pages, chunk and result JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import newlines

CHUNK_JSON = "chunk_id long, {text} string, metadata map<string,string>, length int, embedding array<float>, embedding_model string"
RESULT_JSON = "results array<struct<id:string,document:string,metadata:map<string,string>,distance:double,similarity:double>>"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, markdown) of whole files, line ends made \\n."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), newlines(F.col("value")).alias("markdown"))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(folder, page_number, raw) of files page_N_raw.txt; pages are numbers, so 10 comes behind 2."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="page_*_raw.txt", recursiveFileLookup=True)
    place = F.col("_metadata.file_path")
    number = F.regexp_extract(place, r"page_(\d+)_raw", 1).cast("int")
    return files.select(F.regexp_extract(place, r"([^/]+)/[^/]*$", 1).alias("folder"), number.alias("page_number"), newlines(F.col("value")).alias("raw"))


def read_chunk_json(spark: SparkSession, path: str, text_field: str = "content") -> DataFrame:
    """Chunks of files chunk_*.json, one object each; a missing text is empty. No files is an error of the reader."""
    read = spark.read.schema(CHUNK_JSON.format(text=text_field)).json(path, multiLine=True, pathGlobFilter="chunk_*.json")
    return read.withColumn(text_field, F.coalesce(text_field, F.lit(""))).withColumnRenamed(text_field, "content")


def read_query_vector(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("embedding array<float>").json(path, multiLine=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result of {"results": [...]}, with its rank."""
    return spark.read.schema(RESULT_JSON).json(path, multiLine=True).select(F.posexplode("results").alias("rank", "r")).select((F.col("rank") + 1).alias("rank"), "r.*")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def write_chunk_json(chunks: DataFrame, path: str, buckets: int = 64, files: int = 4) -> None:
    """Chunks as lines of JSON; documents share `buckets` folders by a hash of their id, each of about `files` files.

    Columns that are null everywhere are written too, so that read_chunk_lines gets the columns back.
    """
    _bucketed(chunks, buckets).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.partitionBy("bucket").option("ignoreNullFields", False).json(path)


def read_chunk_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What write_chunk_json wrote, with the columns of `schema`; an empty folder gives an empty table."""
    return spark.read.schema(schema).json(path, recursiveFileLookup=True, pathGlobFilter="*.json")


def write_chunk_text(exported: DataFrame, path: str, buckets: int = 64) -> None:
    """Rows (document_id, value) of the text export; lines carry no id, so each document has its folder in its bucket."""
    rows = _bucketed(exported.select("document_id", "value"), buckets).repartition("bucket", "document_id")
    rows.write.partitionBy("bucket", "document_id").text(path)


def write_embeddings(embedded: DataFrame, path: str, as_json: bool = False) -> DataFrame:
    """Vectors as Parquet, or as lines of JSON if wanted; returns the index (chunk_id, chunk_file)."""
    if as_json:
        embedded.write.option("ignoreNullFields", False).json(path)
        written = embedded.sparkSession.read.schema(embedded.schema).json(path)
    else:
        embedded.write.parquet(path)
        written = embedded.sparkSession.read.parquet(path)
    return written.select("chunk_id", F.col("_metadata.file_name").alias("chunk_file"))


def write_collection(entries: DataFrame, path: str) -> None:
    """Entries by collection; only the collections written are replaced. The path must not be one that entries reads."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def rewrite_collection(entries: DataFrame, path: str, staging: str, names: list[str] | None = None) -> None:
    """write_collection for entries that were read from `path` itself: written to `staging` first, then swapped in.

    `names` are the collections that the entries stand for: those of them without entries go. Without `names` the
    collections that have entries are replaced and the others stay. If the job stops in between, the staged entries
    are whole. Where readers must never see a half, sources.snapshots keeps collections.
    """
    spark = entries.sparkSession
    entries.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(entries.schema).parquet(staging)
    write_collection(staged, path)
    if names:
        left = {r["collection"] for r in staged.where(F.col("collection").isin(names)).select("collection").distinct().collect()}
        kind = spark._jvm.org.apache.hadoop.fs.Path
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for name in set(names) - left:
            folder = kind(f"{path}/collection={escaped(name)}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_logs(logs: DataFrame, path: str) -> None:
    """Processing steps (document_id, log_id, stage, level, message, created_at) behind those that are there."""
    logs.write.mode("append").parquet(path)
