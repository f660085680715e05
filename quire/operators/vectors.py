"""Vectors of chunks: embedding by a batch function, norms, profiles, pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that embed hands on at once; a multiple of the usual batches of models.
EMBED_ROWS = 1024
#: Words of which a process keeps the hashes.
HASHED_WORDS = 65_536
EmbedFn = Callable[[list[str]], np.ndarray]


@lru_cache(HASHED_WORDS)
def _hashed(word: str) -> tuple[int, int]:
    """A number of 16 bits and a sign, by the first hexadecimal digits of the MD5."""
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:4], 16), 1 if h[4] >= "8" else -1


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in for a model: signed feature hashing of words, by the first hexadecimal digits of their MD5."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        row = [0] * dim
        for word in (text or "").lower().split():
            place, sign = _hashed(word)
            row[place % dim] += sign
        out[i] = row
    return out


def embed(df: DataFrame, text_col: str, embed_fn: EmbedFn = hash_embed, *, batch_size: int = 32, normalize: bool = True, out: str = "embedding") -> DataFrame:
    """df with a vector for each text, made in batches where the rows are; null texts count as empty."""
    df = df.drop(out)
    schema = T.StructType(list(df.schema.fields)).add(out, T.ArrayType(T.FloatType(), False))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[a : a + EMBED_ROWS] for whole in batches for a in range(0, len(whole), EMBED_ROWS)):
            texts = batch[text_col].fillna("").tolist()
            made = [np.asarray(embed_fn(texts[a : a + batch_size]), np.float32) for a in range(0, len(texts), batch_size)]
            mat = np.concatenate(made) if made else np.zeros((0, 1), np.float32)
            if normalize:
                norm = np.linalg.norm(mat, axis=1, keepdims=True)
                mat = mat / np.where(norm == 0, 1, norm)
            yield batch.assign(**{out: list(mat)})

    return df.mapInPandas(rows, schema)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Unit vectors; a zero vector stays."""
    n = norm(F.col(vec_col))
    return df.withColumn(vec_col, F.transform(vec_col, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))


def rounded(x: Column, places: int = 6) -> Column:
    """A double to so many places as C's round does it: halves away from zero, and a zero keeps its sign."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    near = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**places
    # beyond 2 ** 52 a double has no fraction; neither have those that are not finite
    return F.when(scaled < 2.0**52, F.signum(x) * near).otherwise(x)


def vector_profile(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return df.select("id", F.size(vec_col).alias("dims"), F.round(norm(F.col(vec_col)), 6).alias("norm"))


def vector_preview(df: DataFrame, n: int = 5, vec_col: str = "embedding") -> DataFrame:
    return df.select("id", F.slice(vec_col, 1, n).alias("preview"))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors, by (document_id, chunk_index); chunks without one are left out."""
    return chunks.join(vectors.select("document_id", "chunk_index", "embedding"), ["document_id", "chunk_index"]).withColumn("embedding_dimension", F.size("embedding"))


def pairwise_similarity(df: DataFrame) -> DataFrame:
    """(a, b, similarity) of all pairs of a chosen set, of any size: no side is broadcast by force."""
    a, b = df.select(F.col("id").alias("a"), F.col("embedding").alias("va")), df.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("similarity"))


#: Vectors of a tile of the self-join, pivots, vectors among which pivots are chosen.
TILE, PIVOTS, PIVOT_SAMPLE = 2048, 8, 2000


def _pivots(df: DataFrame, n: int, sample: int) -> np.ndarray:
    """Unit vectors far from each other, chosen among a bounded sample by a hash of the id: each the farthest from those before."""
    some = df.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r["embedding"] for r in some], np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else np.zeros((1, 1))
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _angles(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) with norm, the nearest pivot and the angles to all of them."""
    for batch in batches:
        x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, pivots.shape[1]))
        norms = np.linalg.norm(x, axis=1)
        angles = np.arccos(np.clip(x @ pivots.T / np.maximum(norms, 1e-300)[:, None], -1, 1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(angles.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), pa.array(angles.argmin(1).astype(np.int32)), lists], [*batch.schema.names, "norm", "pivot", "angles"])


def _tile_products(batches: Iterator[pa.RecordBatch], least: float, cells: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of rows (one, other, side, id, embedding): the first tile's rows are held, the second's come by."""
    now, held, mine, x = None, [], [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("one", "other", "side")], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for first, end in zip(edges, edges[1:]):
            if first == end:
                continue
            part, (one, other, side) = batch.slice(first, end - first), key[first]
            if (one, other) != now:
                now, held, x = (one, other), [], None
            if side == 0:
                held.append(part)
                continue
            if not held and x is None:
                continue
            if x is None:
                rows = pa.Table.from_batches(held)
                mine, held = np.array([*rows["id"].to_pylist(), None], object)[:-1], []
                x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), -1)
            theirs = np.array([*part.column("id").to_pylist(), None], object)[:-1]
            y = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(theirs), -1)
            step = max(1, cells // len(theirs))
            for at in range(0, len(mine), step):
                s = np.round(x[at : at + step] @ y.T, 6)
                r, c = np.nonzero(s >= least)
                a, b, s = mine[r + at], theirs[c], s[r, c]
                if one == other:  # each pair of a tile once
                    some = a < b
                    a, b, s = a[some], b[some], s[some]
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(s)], ["a", "b", "similarity"])


def similar_pairs(df: DataFrame, least: float, *, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows (id, embedding) whose product, to six places, is `least` or more.

    Vectors are dealt into tiles by their nearest pivot and their angle to it. The angle of two vectors is at least
    the difference of their angles to any pivot; so a pair of tiles is left out if that difference, for the nearest
    ends of their ranges and some pivot, allows no product of `least` with their largest norms. Each other pair of
    tiles meets once, in one shuffle. A tile is of bounded size whatever vectors repeat. ids are distinct; vectors
    that are null are in no pair.
    """
    rows = df.select("id", "embedding").where("embedding is not null and id is not null")
    spark = df.sparkSession
    chosen = _pivots(rows, pivots, PIVOT_SAMPLE)
    schema = T.StructType(list(rows.schema.fields)).add("norm", "double").add("pivot", "integer").add("angles", T.ArrayType(T.DoubleType()))
    placed = rows.mapInArrow(lambda batches: _angles(batches, chosen), schema).withColumn("angle", F.get("angles", F.col("pivot")))
    # edges of the angles of each pivot's vectors, one for each tile; at most as many rows as there are pivots
    size = F.least(F.lit(1000), F.ceil(F.count("*") / tile)).cast("int")
    edges = {r["pivot"]: np.unique(r["at"][:: max(1, 1000 // r["n"])]).tolist() for r in placed.groupBy("pivot").agg(size.alias("n"), F.percentile_approx("angle", [k / 1000 for k in range(1, 1000)], 10_000).alias("at")).collect()}
    if not edges:
        return spark.createDataFrame([], "a string, b string, similarity double")
    table = F.create_map(*[x for p, at in edges.items() for x in (F.lit(p), F.array(*[F.lit(float(v)) for v in at]))])
    placed = placed.withColumn("ring", F.size(F.filter(table[F.col("pivot")], lambda e: e < F.col("angle"))))
    rings = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    # equal vectors stay in one ring, which is dealt further by a hash of the id; at most pivots x 1000 rings
    shares = {(r["pivot"], r["ring"]): -(-r["n"] // tile) for r in rings.collect()}
    first, begins = 0, {}
    for ring, n in sorted(shares.items()):
        begins[ring], first = first, first + n
    at = F.create_map(*[x for (p, r), n in sorted(shares.items()) for x in (F.lit(p * 10_000 + r), F.struct(F.lit(begins[p, r]).cast("long").alias("begin"), F.lit(n).cast("long").alias("n")))])
    ring = at[F.col("pivot") * 10_000 + F.col("ring")]
    tiles = placed.withColumn("tile", ring["begin"] + F.pmod(F.xxhash64("id"), ring["n"]))
    ends = [f(F.get("angles", F.lit(p))).alias(f"{name}{p}") for p in range(len(chosen)) for name, f in (("low", F.min), ("high", F.max))]
    ranges = tiles.groupBy("tile").agg(F.max("norm").alias("norm"), *ends)
    one, other = ranges.select(*[F.col(c).alias(f"{c}_a") for c in ranges.columns]), ranges.select(*[F.col(c).alias(f"{c}_b") for c in ranges.columns])
    gap = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"low{p}_a") - F.col(f"high{p}_b"), F.col(f"low{p}_b") - F.col(f"high{p}_a")) for p in range(len(chosen))])
    most = F.col("norm_a") * F.col("norm_b") * F.cos(F.least(F.greatest(gap - 1e-6, F.lit(0.0)), F.lit(float(np.pi))))
    # tiles, not vectors, are paired here
    pairs = one.join(other, (F.col("tile_a") <= F.col("tile_b")) & (F.greatest(most, F.lit(0.0) if least <= 0 else most) >= least - 1e-5)).select(F.col("tile_a").alias("one"), F.col("tile_b").alias("other"))
    own = tiles.select("tile", "id", "embedding")
    sides = [pairs.join(own, F.col(name) == F.col("tile")).select("one", "other", F.lit(side).alias("side"), "id", "embedding") for side, name in enumerate(("one", "other"))]
    dealt = sides[0].unionByName(sides[1]).repartition("one", "other").sortWithinPartitions("one", "other", "side")
    return dealt.mapInArrow(lambda batches: _tile_products(batches, least), "a string, b string, similarity double")


def item_neighbors(df: DataFrame, item: Column, k: int = 3) -> DataFrame:
    """The k nearest others of one item, the item left out by its id."""
    one = df.where(F.col("id") == item).select(F.col("id").alias("item"), F.col("embedding").alias("v")).limit(1)
    near = df.join(F.broadcast(one), F.col("id") != F.col("item")).withColumn("similarity", F.round(dot(F.col("embedding"), F.col("v")), 6))
    return near.select("item", "id", "similarity").orderBy(F.desc("similarity"), "id").limit(k)


def embedding_run_stats(df: DataFrame, model: str, normalized: bool = True, *, alias: str | None = None, backend: str | None = None, seconds: float | None = None, timestamp: str | None = None) -> DataFrame:
    """One row that describes a run: what the vectors show, and what the caller knows of the model and the time."""
    given = {"model": (model, "string"), "normalized": (normalized, "boolean"), "alias": (alias, "string"), "backend": (backend, "string"), "seconds": (seconds, "double"), "timestamp": (timestamp, "string")}
    shown = df.agg(F.count("*").alias("num_chunks"), F.max(F.size("embedding")).alias("embedding_dimension"))
    return shown.withColumns({name: F.lit(value).cast(kind) for name, (value, kind) in given.items()})
