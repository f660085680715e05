"""Collections kept as snapshots: folders of entries that are written once, and a manifest that names the current ones.

A store is a folder with `data/`, in which each write of a collection has a folder of its own, and `manifests/`, whose
last file names the folders of every collection. A change writes a new folder first and the next manifest last, by a
rename that fails if the manifest is there. So readers see the collections before or after a change, never half of
one; a job that is killed leaves a folder that nothing names; of two jobs that change a store at once the second
fails and can be run again. Only the collection that changes is written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators import collection as ops


class Conflict(RuntimeError):
    """Another job has changed the store in between."""


def _files(spark: SparkSession, path: str):
    """(file system, Path class) of the store, whatever kind of storage it is on."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, kind = _files(spark, path)
    folder = kind(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, collections: {name: {data, schema}}} of a version, the last one as a rule; of a new store version 0."""
    known = _versions(spark, path)
    version = version if version is not None else (known[-1] if known else 0)
    if not version:
        return {"version": 0, "collections": {}}
    lines = spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).collect()
    return json.loads(lines[0]["value"])


def _commit(spark: SparkSession, path: str, before: dict, collections: dict) -> int:
    """Name the next version; the last step of every change."""
    version = before["version"] + 1
    text = json.dumps({"version": version, "collections": collections})
    fs, kind = _files(spark, path)
    fs.mkdirs(kind(f"{path}/manifests"))
    waiting, named = kind(f"{path}/manifests/.{uuid.uuid4().hex}"), kind(f"{path}/manifests/{version:012d}.json")
    out = fs.create(waiting, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(named) or not fs.rename(waiting, named):
        fs.delete(waiting, False)
        raise Conflict(f"version {version} of {path} is there already")
    return version


def names(spark: SparkSession, path: str) -> list[str]:
    """Collections of a store, empty ones too."""
    return sorted(manifest(spark, path)["collections"])


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """The entries of a collection; an empty collection has no rows and its columns."""
    known = manifest(spark, path, version)["collections"]
    if name not in known:
        raise KeyError(f"no collection {name} in {path}")
    schema = StructType.fromJson(known[name]["schema"])
    if not known[name]["data"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in known[name]["data"]])


def replace(entries: DataFrame, path: str, name: str, *, before: dict | None = None) -> int:
    """Make `entries`, which may be read from the store itself, the whole of a collection. Returns the version."""
    spark = entries.sparkSession
    before = before or manifest(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    entries.write.parquet(f"{path}/{folder}")
    return _commit(spark, path, before, before["collections"] | {name: {"data": [folder], "schema": entries.schema.jsonValue()}})


def add(entries: DataFrame, path: str, name: str) -> int:
    """Put entries of new ids, of the collection's columns, beside those that are there, which aren't written again."""
    spark = entries.sparkSession
    before = manifest(spark, path)
    known = before["collections"].get(name)
    if known is None:
        return replace(entries, path, name, before=before)
    schema = StructType.fromJson(known["schema"])
    entries = entries.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    folder = f"data/{uuid.uuid4().hex}"
    entries.write.parquet(f"{path}/{folder}")
    return _commit(spark, path, before, before["collections"] | {name: known | {"data": [*known["data"], folder]}})


def upsert(incoming: DataFrame, path: str, name: str, on_conflict: str = "replace", order: str = "position") -> int:
    """Put incoming rows in by id: see operators.collection.upsert."""
    spark = incoming.sparkSession
    before = manifest(spark, path)
    return replace(ops.upsert(load(spark, path, name, before["version"]), incoming, on_conflict, order), path, name, before=before)


def delete(ids: DataFrame, path: str, name: str) -> int:
    """Take the entries of some ids out; a collection of which none is left stays as an empty one."""
    spark = ids.sparkSession
    before = manifest(spark, path)
    return replace(ops.delete_by_ids(load(spark, path, name, before["version"]), ids), path, name, before=before)


def reset(spark: SparkSession, path: str, name: str) -> int:
    """Empty a collection; nothing is written but the manifest."""
    before = manifest(spark, path)
    return _commit(spark, path, before, before["collections"] | {name: before["collections"][name] | {"data": []}})


def drop(spark: SparkSession, path: str, name: str) -> int:
    """Remove a collection from the store."""
    before = manifest(spark, path)
    return _commit(spark, path, before, {n: c for n, c in before["collections"].items() if n != name})


def stats(spark: SparkSession, path: str, metric: str = "cosine") -> DataFrame:
    """(collection, n, metric) of every collection, empty ones too."""
    now = manifest(spark, path)
    counts = None
    for name in sorted(now["collections"]):
        rows = load(spark, path, name, now["version"]).agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n", F.lit(metric).alias("metric"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts if counts is not None else spark.createDataFrame([], "collection string, n long, metric string")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete folders that none of the last `keep` versions names, and older manifests. No job may be writing or reading them."""
    versions = _versions(spark, path)
    kept = versions[-keep:]
    named = {folder for v in kept for c in manifest(spark, path, v)["collections"].values() for folder in c["data"]}
    fs, kind = _files(spark, path)
    folder = kind(f"{path}/data")
    there = [f"data/{s.getPath().getName()}" for s in fs.listStatus(folder)] if fs.exists(folder) else []
    gone = sorted(set(there) - named)
    for f in gone:
        fs.delete(kind(f"{path}/{f}"), True)
    for v in versions[:-keep]:
        fs.delete(kind(f"{path}/manifests/{v:012d}.json"), False)
    return gone
