"""Results of model calls that are kept between runs: vectors by text, scores by pair.

A store is a Parquet table of (model, key, values), dealt into folders by model and by a hash of the key, so that keys
meet keys of the same folder only. A run looks its distinct keys up, calls the model for those that are missing, adds
the new rows and joins. Rows are only ever added; two runs at once may add the same key, of which one row is read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.rerank import ScoreFn, score_pairs
from quire.operators.vectors import EmbedFn, embed

BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a folder made for this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def key_of(*texts: Column | str) -> Column:
    """The key of some texts: SHA-256 of their lengths and contents; null counts as empty."""
    parts = [F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")) for t in texts]
    return F.sha2(F.concat_ws(" ", *[F.length(p).cast("string") for p in parts], *parts), 256)


def stored(spark: SparkSession, path: str, model: str, values: str) -> DataFrame:
    """(bucket, key, values) of a model; without a store none. `values` are columns as in a schema."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    place = kind(path)
    schema = StructType.fromDDL(f"key string, {values}, model string, bucket int")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema).drop("model")
    return spark.read.schema(schema).parquet(path).where(F.col("model") == model).drop("model").dropDuplicates(["bucket", "key"])


def through_store(rows: DataFrame, key: Column, path: str, model: str, values: str, make: Callable[[DataFrame], DataFrame], texts: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with the values of their keys; `make` gives them for the distinct (key, texts) that the store lacks.

    What is missing is written before it is used: an executor that is lost afterwards asks no model again.
    """
    spark = rows.sparkSession
    names = [f.name for f in StructType.fromDDL(values)]
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    keyed = rows.drop(*names).withColumn("key", key).withColumn("bucket", bucket)
    asked = keyed.groupBy("bucket", "key").agg(*[F.first(t).alias(t) for t in texts])
    missing = asked.join(stored(spark, path, model, values), ["bucket", "key"], "left_anti")
    made = make(missing.drop("bucket")).select("key", *names, F.lit(model).alias("model"), bucket.alias("bucket"))
    made.write.mode("append").partitionBy("model", "bucket").parquet(path)
    return keyed.join(stored(spark, path, model, values), ["bucket", "key"]).drop("bucket", "key")


def embed_stored(df: DataFrame, text_col: str, path: str, model: str, embed_fn: EmbedFn, *, batch_size: int = 32, normalize: bool = True, out: str = "embedding", buckets: int = BUCKETS) -> DataFrame:
    """vectors.embed with vectors kept by text: each distinct text goes to the function once over all runs.

    Within a task texts go by length, so that a batch holds texts alike. Normalised and plain vectors of a model are
    kept apart.
    """

    def make(missing: DataFrame) -> DataFrame:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = missing.withColumnRenamed(text_col, "text").repartition(tasks, "key").sortWithinPartitions(F.length("text"), "key")
        return embed(dealt, "text", embed_fn, batch_size=batch_size, normalize=normalize, out=out)

    return through_store(df, key_of(text_col), path, model if normalize else f"{model} plain", f"{out} array<float>", make, [text_col], buckets)


def score_stored(pairs: DataFrame, path: str, model: str, score_fn: ScoreFn | None = None, *, batch_size: int = 32, buckets: int = BUCKETS) -> DataFrame:
    """rerank.score_pairs with scores kept by the pair (text, document): only new pairs go to the function."""
    return through_store(pairs, key_of("text", "document"), path, model, "rerank_score double", lambda missing: score_pairs(missing, score_fn, batch_size), ["text", "document"], buckets)
