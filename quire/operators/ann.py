"""Approximate k-NN by cosine: cells that grow with the table, product-quantised codes, exact rescoring.

A model is learned from a bounded sample: centers of about root-of-n cells, and a codebook for each few components of
a unit vector. The index is two tables by cell: codes, a byte for each codebook, and vectors. A query's distances to
all codebook entries are looked up for the codes of its nearest cells; the best few candidates by these sums get their
exact distances. Large cells are dealt into tiles, many queries into blocks, and a code meets a query in one shuffle of
codes, which are a small part of the vectors' size.

The index takes new and changed entries into its cells without being learned anew: only cells that have to change are
written again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.search import _ranked, distance

#: Entries learned from at most, cells at most, components of one codebook, its entries, rounds of learning.
SAMPLE, MOST_CELLS, WIDTH, ENTRIES, ROUNDS = 20_000, 4096, 4, 256, 8
#: Share of the cells that a query looks into, and candidates for each of the k that are rescored exactly.
PROBED, RESCORED = 0.7, 24
#: Codes of a tile and queries of a block that meet in one place.
TILE_CODES, BLOCK_QUERIES = 1 << 20, 1024
#: Codes of the cells of a bundle, to which a query goes as one row.
BUNDLE_CODES = 16_384
_CANDIDATES = "query_id long, id string, cell int, near double"


@dataclass
class Model:
    """Cell centers and codebooks (book, entry, component) of unit vectors of `dims` components."""

    centers: np.ndarray
    books: np.ndarray
    dims: int

    @property
    def cells(self) -> int:
        return len(self.centers)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centers of the rows of x; empty ones begin again at random rows."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=len(centers))
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        centers[~full] = x[rng.integers(0, len(x), (~full).sum())]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    out = np.empty((len(x), min(n, len(centers))), np.int32)
    half = (centers * centers).sum(1) / 2
    for a in range(0, len(x), 4096):
        d = half - x[a : a + 4096] @ centers.T
        out[a : a + 4096] = np.argsort(d, 1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None]
    return out


def learn(entries: DataFrame, *, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Model:
    """A model of `sample` entries, chosen by a hash of the id, made in one task; the driver gets the model only.

    Without `cells` there are as many as the root of the number of entries, between 1 and MOST_CELLS.
    """
    usable = entries.where("embedding is not null")
    cells = cells or max(1, min(MOST_CELLS, int(usable.count() ** 0.5)))
    some = usable.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held).sort_by("id") if held else None
        model = Model(np.zeros((1, 1)), np.zeros((1, 1, 1)), 0)
        if rows is not None and len(rows):
            rng = np.random.default_rng(seed)
            x = _matrix(rows["embedding"].combine_chunks(), len(rows))
            dims = x.shape[1]
            x = np.pad(_unit(x), ((0, 0), (0, -dims % WIDTH)))
            books = [_means(x[:, a : a + WIDTH], ENTRIES, ROUNDS, rng) for a in range(0, x.shape[1], WIDTH)]
            model = Model(_means(x, cells, ROUNDS, rng), np.stack(books), dims)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = [r["model"] for r in some.repartition(1).mapInArrow(one, "model binary").collect()]
    return pickle.loads(made[0]) if made else Model(np.zeros((1, 1)), np.zeros((1, 1, 1)), 0)


def encoded(entries: DataFrame, model: Model) -> DataFrame:
    """(cell, id, code, embedding) of every entry that has a vector."""
    sent = entries.sparkSession.sparkContext.broadcast(model)
    kind = entries.schema["embedding"].dataType
    schema = T.StructType().add("cell", "integer").add("id", "string").add("code", "binary").add("embedding", kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            x = np.pad(_unit(_matrix(batch.column("embedding"), n)), ((0, 0), (0, -m.dims % WIDTH))) if n else np.zeros((0, m.centers.shape[1]))
            code = np.stack([_nearest(x[:, k * WIDTH : (k + 1) * WIDTH], book, 1)[:, 0] for k, book in enumerate(m.books)], 1).astype(np.uint8)
            cell = _nearest(x, m.centers, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding")], ["cell", "id", "code", "embedding"])

    return entries.select("id", "embedding").where("embedding is not null").mapInArrow(rows, schema)


def _probes(queries: DataFrame, model: Model, n: int, bundles: np.ndarray) -> DataFrame:
    """(query_id, bundle, cells, q): the n nearest cells of each query, those of a bundle in one row; q is a unit vector."""
    sent = queries.sparkSession.sparkContext.broadcast((model, bundles))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bundle_of = sent.value
        for batch in (whole.slice(a, BLOCK_QUERIES) for whole in batches for a in range(0, whole.num_rows, BLOCK_QUERIES)):
            x = np.pad(_unit(_matrix(batch.column("embedding"), batch.num_rows)), ((0, 0), (0, -m.dims % WIDTH)))
            cells = _nearest(x, m.centers, n)
            into = np.zeros((len(x), m.cells), bool)
            np.put_along_axis(into, cells, True, 1)
            for bundle in range(bundle_of.max() + 1):
                own = np.flatnonzero(bundle_of == bundle).astype(np.int32)
                some = np.flatnonzero(into[:, own].any(1))
                lists = [own[row] for row in into[np.ix_(some, own)]]
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(some)), pa.array(np.full(len(some), bundle, np.int32)), pa.array(lists, pa.list_(pa.int32())), pa.array(list(x[some]), pa.list_(pa.float64()))], ["query_id", "bundle", "cells", "q"])

    placed = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("embedding is not null")
    return placed.mapInArrow(rows, "query_id long, bundle int, cells array<int>, q array<double>")


def _met(batches: Iterator[pa.RecordBatch], model: Model, keep: int) -> Iterator[pa.RecordBatch]:
    """The `keep` nearest codes of each query in each place: rows (bundle, tile, block, cell, query_id, cells, q, id, code).

    Queries come first, with cell -1, then the codes of one cell after the other; a cell's codes meet the queries that
    look into it.
    """
    now, held, ids, tables, best, into = None, [], None, None, None, None

    def told():
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2].tolist(), pa.string()), pa.array(best[3].astype(np.int32)), pa.array(best[1])], ["query_id", "id", "cell", "near"])

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("bundle", "tile", "block", "cell")], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for first, end in zip(edges, edges[1:]):
            if first == end:
                continue
            part, place, cell = batch.slice(first, end - first), tuple(key[first][:3]), int(key[first][3])
            if place != now:
                yield from told()
                now, held, ids, tables, best = place, [], None, None, None
            if cell < 0:
                held.append(part)
                continue
            if tables is None:
                if not held:
                    continue
                rows = pa.Table.from_batches(held)
                ids, held = rows["query_id"].to_numpy(), []
                lists = rows["cells"].combine_chunks()
                into = np.zeros((len(ids), model.cells), bool)
                into[np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                q = _matrix(rows["q"].combine_chunks(), len(ids)).reshape(len(ids), len(model.books), WIDTH)
                # minus twice the product and the entry's square: the order of distances to what a code stands for
                tables = (model.books**2).sum(2)[None] - 2 * np.einsum("nbw,bew->nbe", q, model.books)
                best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64)
            names = np.array([*part.column("id").to_pylist(), None], object)[:-1]
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(names), -1)
            asking = np.flatnonzero(into[:, cell])
            step = max(1, 2_000_000 // max(1, len(names)))
            for a in range(0, len(asking), step):
                own = asking[a : a + step]
                near = sum(tables[own, b][:, codes[:, b]] for b in range(codes.shape[1]))
                limit = np.partition(near, keep - 1, 1)[:, keep - 1 : keep] if near.shape[1] > keep else np.full((len(own), 1), np.inf)
                r, c = np.nonzero(near <= limit)
                mine = np.isin(best[0], own)
                rows_, d, n, at = (np.concatenate([old[mine], new]) for old, new in zip(best, (own[r], near[r, c], names[c], np.full(len(r), cell))))
                order = np.lexsort((n, d, rows_))
                rows_, d, n, at = rows_[order], d[order], n[order], at[order]
                some = np.arange(len(rows_)) - np.searchsorted(rows_, rows_) < keep
                best = tuple(np.concatenate([old[~mine], new[some]]) for old, new in zip(best, (rows_, d, n, at)))
    yield from told()


def _candidates(queries: DataFrame, codes: DataFrame, sizes: dict[int, int], model: Model, probes: int, keep: int) -> DataFrame:
    """(query_id, id, cell, near): `keep` candidates of each query over all cells that it looks into.

    Cells stand in bundles of BUNDLE_CODES codes or one cell, and a query goes once to each bundle, not to each cell.
    """
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    if not any(sizes.values()):
        return queries.sparkSession.createDataFrame([], _CANDIDATES)
    bundles, held = np.zeros(model.cells, np.int32), 0
    for cell in range(1, model.cells):
        held += sizes.get(cell - 1, 0)
        more = held + sizes.get(cell, 0) > BUNDLE_CODES
        bundles[cell] = bundles[cell - 1] + more
        held = 0 if more else held
    # only a cell alone in its bundle can be larger than it
    totals = np.bincount(bundles, [sizes.get(c, 0) for c in range(model.cells)])
    many = {b: int(-(-n // TILE_CODES)) for b, n in enumerate(totals) if n > TILE_CODES}
    lookup = lambda pairs: F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])
    n_tiles = F.coalesce(lookup(many)[F.col("bundle")], F.lit(1)) if many else F.lit(1)
    bundle = F.get(F.array(*[F.lit(b) for b in bundles.tolist()]), F.col("cell")).alias("bundle")
    none = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = _probes(queries, model, probes, bundles).select("bundle", every(n_tiles).alias("tile"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(-1).alias("cell"), "query_id", "cells", "q", none("string").alias("id"), none("binary").alias("code"))
    e = codes.select(bundle, "cell", "id", "code").select("bundle", F.pmod(F.xxhash64("id"), n_tiles).cast("int").alias("tile"), every(F.lit(n_blocks)).alias("block"), "cell", none("long").alias("query_id"), none("array<int>").alias("cells"), none("array<double>").alias("q"), "id", "code")
    sent = queries.sparkSession.sparkContext.broadcast(model)
    dealt = q.unionByName(e).repartition("bundle", "tile", "block").sortWithinPartitions("bundle", "tile", "block", "cell")
    near = dealt.mapInArrow(lambda batches: _met(batches, sent.value, keep), _CANDIDATES)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")


def _search(queries: DataFrame, codes: DataFrame, vectors: DataFrame, model: Model, k: int, probed: float, rescored: int) -> DataFrame:
    sizes = {r["cell"]: r["n"] for r in codes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many rows as cells
    probes = max(1, round(probed * model.cells))
    some = _candidates(queries, codes, sizes, model, probes, k * rescored).select("query_id", "id", "cell")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    exact = vectors.select("cell", "id", "embedding").join(some, ["cell", "id"]).join(asked, "query_id")
    return _ranked(exact.select("query_id", "id", F.round(distance(F.col("embedding"), F.col("q"), "cosine"), 6).alias("distance")), k)


def knn_quantised(queries: DataFrame, entries: DataFrame, k: int = 5, *, cells: int | None = None, probed: float = PROBED, rescored: int = RESCORED, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """Approximate k-NN without an index that is kept: learned, encoded and searched in one go."""
    model = learn(entries, cells=cells, sample=sample, seed=seed)
    placed = encoded(entries, model)
    return _search(queries, placed.select("cell", "id", "code"), placed, model, k, probed, rescored)


# ----------------------------------------------------------------- an index that is kept


def _write(placed: DataFrame, path: str, files: int, mode: str = "static") -> None:
    """Codes and vectors by cell, a cell in about `files` files; with "dynamic" only the cells of `placed` are replaced."""
    dealt = lambda df: df.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files)))
    for name, columns in (("codes", ["cell", "id", "code"]), ("vectors", ["cell", "id", "embedding"])):
        dealt(placed.select(*columns)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("cell").parquet(f"{path}/{name}")


def write_index(entries: DataFrame, path: str, *, cells: int | None = None, sample: int = SAMPLE, seed: int = 1, files: int = 4) -> Model:
    """Learn a model and write it with the codes and vectors of all entries."""
    model = learn(entries, cells=cells, sample=sample, seed=seed)
    spark = entries.sparkSession
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").write.mode("overwrite").parquet(f"{path}/model")
    _write(encoded(entries, model), path, files)
    return model


def read_model(spark: SparkSession, path: str) -> Model:
    """The model of an index of one's own: it is a pickle, so no index of strangers should be opened."""
    return pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()["model"]))


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    column = {"codes": "code binary", "vectors": "embedding array<float>"}[name]
    return spark.read.schema(f"id string, {column}, cell int").parquet(f"{path}/{name}")


def upsert_index(incoming: DataFrame, path: str, staging: str, *, files: int = 4) -> list[int]:
    """Put entries in by id, in the cells of the model that is there. Returns the cells that were written again.

    Those are the cells that new entries go to and those that held an entry of their ids before. They are written to
    `staging` first. A cell that loses its last entry is emptied.
    """
    spark = incoming.sparkSession
    model = read_model(spark, path)
    rows = incoming.select("id", "embedding").dropDuplicates(["id"])
    encoded(rows, model).write.mode("overwrite").parquet(f"{staging}/incoming")
    new = spark.read.parquet(f"{staging}/incoming")
    ids = rows.select("id")
    old = _table(spark, path, "codes").join(ids, "id", "left_semi").select("cell")
    touched = sorted(r["cell"] for r in new.select("cell").union(old).distinct().collect())  # cells, MOST_CELLS at most
    if not touched:
        return []
    in_them = lambda name: _table(spark, path, name).where(F.col("cell").isin(touched)).join(ids, "id", "left_anti")
    kept = in_them("vectors").join(in_them("codes").select("id", "code"), "id").select("cell", "id", "code", "embedding")
    kept.unionByName(new.select(*kept.columns)).write.mode("overwrite").parquet(f"{staging}/cells")
    whole = spark.read.parquet(f"{staging}/cells")
    _write(whole, path, files, "dynamic")
    left = {r["cell"] for r in whole.select("cell").distinct().collect()}
    kind = spark._jvm.org.apache.hadoop.fs.Path
    for cell in set(touched) - left:
        for name in ("codes", "vectors"):
            folder = kind(f"{path}/{name}/cell={cell}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def search_index(queries: DataFrame, path: str, k: int = 5, *, probed: float = PROBED, rescored: int = RESCORED) -> DataFrame:
    """Approximate k-NN over what write_index wrote; nothing is learned again."""
    spark = queries.sparkSession
    return _search(queries, _table(spark, path, "codes"), _table(spark, path, "vectors"), read_model(spark, path), k, probed, rescored)
