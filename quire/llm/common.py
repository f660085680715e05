"""What the operators of this subpackage share: materialised tables, byte-level tokenising, links to components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ----------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a folder made for this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables that this process has written to shared folders and not removed.
_saved: list[str] = []


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _saved.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Remove the tables that `save` has written so far; the results that are read from them are gone then, too."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    n = len(_saved)
    while _saved:
        place = kind(_saved.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows that a Python worker gets at once where rows are large.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of at most BATCH_BYTES (a larger row alone)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as dictionaries, one in memory at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


# ----------------------------------------------------------------- bytes of a column of strings

#: Texts are taken apart in runs of about so many bytes. What stands beside them takes some fifty bytes for each, and
#: every worker of an executor holds it at once.
SLICE_BYTES = 1 << 19


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes.

    Yields (first row, end row, bytes, offsets of the rows in these bytes). A null is an empty string; a row
    longer than the limit is a run of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


# ----------------------------------------------------------------- words and their hashes

_RNG = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
#: 0 white space, 1 letters, digits and all bytes of other alphabets, 2 other ASCII
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[128:] = 1
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    _KIND[_first:_last] = 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_POWERS: dict[str, np.ndarray] = {}
#: Tables of powers, 16 bytes for each byte of a text, are kept up to this length.
_KEPT_POWERS = (4 << 20) + 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        if n > _KEPT_POWERS:
            return _powers(_BASE, n), _powers(_BASE_INV, n)
        size = SLICE_BYTES + 1 if n <= SLICE_BYTES + 1 else _KEPT_POWERS
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = True, by_kind: bool = False, prefixes: tuple[int, ...] = ()):
    """(hash, row) of every word of some rows, in order, and the number of words of each row.

    With `prefixes`, a list follows: for each length in bytes, (hash, row) of the beginnings of the longer words.

    A word is a maximal run of bytes that are not ASCII white space, A-Z taken as a-z if `lower`; with `by_kind`
    runs of letters or digits and runs of punctuation count apart.
    """
    n_rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return (*none, np.zeros(n_rows, np.int64)) + (([none for _ in prefixes],) if prefixes else ())
    if by_kind:
        kind = _KIND[data]
        new = np.empty(len(data), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(data))
        keep = kind[at] != 0
        starts, ends = at[keep], ends[keep]
    else:
        space = _SPACE[data].astype(bool)
        inside = ~space
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = inside.copy()
        begin[1:] &= space[:-1] | first[1:]
        last = np.empty(len(data), bool)
        last[:-1] = space[1:] | first[1:]
        last[-1] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(inside & last) + 1
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    rows = np.repeat(np.arange(n_rows), counts)
    if not prefixes:
        return h, rows, counts
    begun = []
    for k in prefixes:
        at = np.flatnonzero(ends - starts > k)
        begun.append((mix((total[starts[at] + k] - total[starts[at]]) * down[starts[at]] + np.uint64(k)), rows[at]))
    return h, rows, counts, begun


# ----------------------------------------------------------------- labelled samples


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model sees: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most max_rows labelled documents that are not held out, by a hash of the id.

    The ids and labels chosen, max_rows at most, are broadcast to the documents. Null labels don't count; of
    several labels of an id the largest holds, of several texts the least.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min(F.coalesce(text_col, F.lit(""))).alias("text"))


def learned(sample: DataFrame, id_col: str, learn):
    """What `learn` makes of a bounded sample, as one table in order of the ids, in one task.

    The driver gets the model only, not the rows; a lost executor's task runs again.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        sample = pa.Table.from_batches(rows).sort_by(id_col) if rows else None
        rows.clear()
        model = learn(sample)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = [row["model"] for row in sample.repartition(1).mapInArrow(one, "model binary").collect()]
    return pickle.loads(made[0]) if made else learn(None)


def list_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of lists of numbers, without copies."""
    column = column.combine_chunks()
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


# ----------------------------------------------------------------- links to components


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node that has one.

    Alternates the large-star and small-star steps until no link changes; every round is a table in the shared
    folder. A hub's links are never gathered: its least neighbour is a partial aggregate and the way back is a
    join, whose large partitions are split. Empty links give no rows; loops and repeated links don't matter.
    """
    spark = links.sparkSession
    now = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    sums = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
    before = sums(now)
    if not before["n"]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = save(small.where("u <> v").distinct(), name)
        after = sums(now)
        if after == before:
            break
        before = after
    least = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.select(F.col("v").alias("node"), F.col("v").alias("component")))
