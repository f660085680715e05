"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from random-hyperplane buckets and is refined by local joins: whoever meets at a common
neighbour is compared, and lists keep the nearest. Vectors whose list is full of links are saturated; their lists are
enlarged to all vectors of their component that can lie near enough: the component is dealt into blocks of vectors that
lie alike, blocks too far from each other for any link are never compared, and the others hand over counts, not pairs.
An audit holds samples of vectors against all of them and asks for further rounds if links are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import components, save

#: Length of the lists; bucket tables; members of a bucket or hub that meet at once; rows of a block.
K, TABLES, MEET, BLOCK = 12, 16, 96, 4096
#: Further hyperplanes for groups of more than MEET; how many times MEET a part of these may have.
FINE, PART_MEETS = 20, 4
#: Rounds of local joins before the audit; recall asked, and the least that is given out when no further links come up.
ROUNDS, RECALL, LEAST_RECALL = 1, 0.97, 0.9
#: Audited vectors of those that have links, inside and outside saturated components, and of those that have none.
LINKED, AUDITED = 256, 1024
#: Rows of a product of a block with another.
TILE = 512
_META = T.StructType().add("v", "long").add("u", "long").add("sim", "double")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): vectors of at least one component, all finite, not all zero, made unit length in doubles."""
    as_double = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id is not null and size(x) > 0")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = F.array_max(F.transform("x", F.abs))
    scaled = as_double.where(~F.coalesce(bad, F.lit(True)) & F.coalesce(top > 0, F.lit(False))).withColumn("x", F.transform("x", lambda c: F.try_divide(c, top)))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    return scaled.select("id", F.transform("x", lambda c: F.try_divide(c, norm)).alias("vec"))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Rows of each run of equal keys (the first columns, long) of sorted batches; the last column are vectors."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        vec = batch.columns[-1]
        size = len(vec.flatten()) // max(1, len(vec)) if len(vec) else 0
        equal = len(vec) and (np.diff(vec.offsets.to_numpy()) == size).all()
        mat = vec.flatten().to_numpy().reshape(-1, size) if equal else np.array([np.asarray(x) for x in vec.to_pylist()] + [None], object)[:-1]
        now = [*cols, mat]
        if rest is not None:
            if mat.dtype != object and rest[-1].dtype != object and rest[-1].shape[1:] == mat.shape[1:]:
                now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
            else:
                listed = lambda m: np.array([*map(np.asarray, m), None], object)[:-1]
                now = [*(np.concatenate([a, b]) for a, b in zip(rest[:-1], now[:-1])), np.concatenate([listed(rest[-1]), listed(now[-1])])]
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), bool)
        for key in now[:n_keys]:
            new[1:] |= key[1:] != key[:-1]
        edges = [0, *np.flatnonzero(new)]
        for a, b in zip(edges, edges[1:]):
            yield [x[a:b] for x in now]
        rest = [x[edges[-1] :] for x in now]
    if rest is not None:
        yield rest


def _stack(mat: np.ndarray) -> np.ndarray:
    return np.stack(mat) if mat.dtype == object else mat


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local joins: of each run, for each member the nearest others that are nearer than its list's last."""
    v, u, s, n = [], [], [], 0
    for _, _, ids, last, mat in _runs(batches, 2):
        ids, first = np.unique(ids, return_index=True)
        if len(ids) < 2:
            continue
        mat, last = _stack(mat[first]), last[first]
        sim = mat @ mat.T
        np.fill_diagonal(sim, -2)
        k = min(K, len(ids) - 1)
        near = np.argpartition(-sim, k - 1, 1)[:, :k]
        got = np.take_along_axis(sim, near, 1)
        r, c = np.nonzero(got > last[:, None])
        v.append(ids[r])
        u.append(ids[near[r, c]])
        s.append(np.round(got[r, c].astype(np.float64), 6))  # a pair that meets again has the same number
        n += len(r)
        if n > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (v, u, s)], _META.names)
            v, u, s, n = [], [], [], 0
    if v:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (v, u, s)], _META.names)


def _compared(groups: DataFrame) -> DataFrame:
    """Local joins of the groups (g1, g2) of (v, last, vec)."""
    rows = groups.select("g1", "g2", "v", "last", "vec").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return rows.mapInArrow(_meet, _META)


def _salted(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """groups with g1, g2: of groups of more than MEET members, those on the same sides of further hyperplanes meet.

    Members of a group that lie alike stay together. Parts of more than PART_MEETS * MEET members, which lie alike on all
    sides, are dealt out by a hash of the member.
    """
    sizes = groups.groupBy(key).agg(F.least(F.lit(FINE), F.ceil(F.log2(F.count("*") / MEET))).cast("int").alias("deep")).where("deep > 0")
    deep = F.coalesce(F.col("deep"), F.lit(0))
    coded = groups.join(sizes, key, "left").withColumn("part", F.col("fine").bitwiseAND(F.expr("shiftleft(1L, coalesce(deep, 0)) - 1")))
    large = coded.where(deep > 0).groupBy(key, "part").agg(F.ceil(F.count("*") / (PART_MEETS * MEET)).cast("long").alias("parts")).where("parts > 1")
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v", F.lit(seed)), "parts")).cast("long")
    return coded.join(large, [key, "part"], "left").select(F.col(key).alias("g1"), (F.shiftleft(salt, FINE) + F.col("part")).alias("g2"), "v", "last", "vec")


def _sides(points: DataFrame, tables: int, bits: int, seed: int, name: str) -> DataFrame:
    """points (v, last, vec) with `name`, for each table the number of the sides of `bits` random hyperplanes."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.diff(lists.offsets.to_numpy())
            codes = np.empty((batch.num_rows, tables), np.int64)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - (lists.offsets.to_numpy()[0] if batch.num_rows else 0)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                mat = flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                planes = np.random.default_rng([seed, int(d)]).normal(size=(d, tables * bits))
                side = (mat @ planes > 0).reshape(len(rows), tables, bits)
                codes[rows] = (side * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits) + (int(d) << 40)
            lists_out = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_out], [*batch.schema.names, name])

    schema = T.StructType(list(points.schema.fields)).add(name, T.ArrayType(T.LongType()))
    return points.mapInArrow(sides, schema)


def _with_fine(points: DataFrame, seed: int) -> DataFrame:
    """(v, last, vec, fine): fine has a bit for the side of each of FINE further hyperplanes."""
    return _sides(points.select("v", "last", "vec"), 1, FINE, seed + 7919, "fines").select("v", "last", "vec", F.col("fines")[0].alias("fine"))


def _buckets(points: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(g, v, last, vec, fine): each vector in a bucket of each table, by the sides of random hyperplanes."""
    coded = _sides(_with_fine(points, seed), tables, bits, seed, "codes")
    return coded.select(F.explode("codes").alias("g"), "v", "last", "vec", "fine")


def _merged(lists: DataFrame | None, found: DataFrame) -> DataFrame:
    """(v, u, sim): the K nearest of each vector among its list and what was found; each task ranks before rows move."""
    every = found if lists is None else lists.unionByName(found)
    nearest = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return every.withColumn("nth", F.dense_rank().over(nearest)).where(F.col("nth") <= K).groupBy("v", "u").agg(F.max("sim").alias("sim"))


def _with_last(points: DataFrame, lists: DataFrame) -> DataFrame:
    """points with `last`, the similarity of the list's last; of a list that isn't full, -2."""
    last = lists.groupBy("v").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select("v", F.when(F.col("n") >= K, F.col("least")).otherwise(-2.0).alias("last"))
    return points.drop("last").join(last, "v", "left").select("v", F.coalesce("last", F.lit(-2.0)).alias("last"), "vec")


def _decided(lists: DataFrame, points: DataFrame, threshold: float, error: float) -> DataFrame:
    """(v, u) of the pairs of the lists whose cosine in doubles reaches the threshold; sim may be off by `error`."""
    open_ = lists.where(F.abs(F.col("sim") - threshold) <= error)
    both = open_.join(points.select("v", F.col("vec").alias("a")), "v").join(points.select(F.col("v").alias("u"), F.col("vec").alias("b")), "u")
    cosine = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return lists.where(F.col("sim") > threshold + error).select("v", "u").unionByName(both.where(cosine >= threshold).select("v", "u"))


def _refined(points: DataFrame, lists: DataFrame, threshold: float, seed: int) -> DataFrame:
    """One round of neighbours of neighbours: all who name a vector, and all it names, meet at it.

    Two vectors within the threshold's angle, one of them so near to a common neighbour, are within twice the angle
    of it; neighbours farther away don't take part.
    """
    close = lists.where(F.col("sim") >= 2 * threshold * threshold - 1)
    at = close.select(F.col("u").alias("c"), "v").unionByName(close.select(F.col("v").alias("c"), F.col("u").alias("v"))).unionByName(close.select(F.col("v").alias("c"), "v")).distinct()
    groups = at.join(_with_fine(_with_last(points, lists), seed), "v")
    return save(_merged(lists, _compared(_salted(groups, "c", seed))), "nn-lists")


def _counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(v, links) of the pairs of two blocks, or of one with itself; weights are numbers of copies."""
    for _, a, b, side, ids, weight, mat in _runs(batches, 3):
        mat = _stack(mat)
        first, second = np.flatnonzero(side == a[0]), np.flatnonzero(side == b[0])
        same, back = a[0] == b[0], np.zeros(len(second), np.int64)
        for k in range(0, len(first), TILE):
            some = first[k : k + TILE]
            hit = (mat[some] @ mat[second].T >= threshold).astype(np.int64)
            if same:
                hit[np.arange(len(some)), k + np.arange(len(some))] = 0
            else:
                back += weight[some] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(hit @ weight[second])], ["v", "links"])
        if not same:
            yield pa.RecordBatch.from_arrays([pa.array(ids[second]), pa.array(back)], ["v", "links"])


def _centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, side, center, radius) of each block: the mean direction and the largest angle to it."""
    for component, side, mat in _runs(batches, 2):
        mat = _stack(mat)
        center = mat.mean(0)
        center /= max(float(np.linalg.norm(center)), 1e-300)
        radius = float(np.arccos(np.clip(mat @ center, -1, 1)).max())
        yield pa.RecordBatch.from_arrays([pa.array(component[:1]), pa.array(side[:1]), pa.array([center.tolist()]), pa.array([radius])], ["component", "side", "center", "radius"])


def _dense(points: DataFrame, dense: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(v, links) of all vectors of dense components (v, component), block by block.

    A component of more than BLOCK vectors is dealt by the sides of hyperplanes, then by a hash. Two blocks are
    compared unless the angle between their centers, less both radii, is above that of the threshold.
    """
    sizes = dense.groupBy("component").agg(F.greatest(F.lit(0), F.least(F.lit(FINE), F.ceil(F.log2(F.count("*") / BLOCK)))).cast("int").alias("deep"))
    placed = dense.join(sizes, "component").join(points, "v")
    fine = _with_fine(placed.select("v", F.lit(0.0).alias("last"), "vec"), seed).select("v", "fine")
    placed = placed.join(fine, "v").withColumn("part", F.expr("fine & (shiftleft(1L, deep) - 1)"))
    parts = placed.groupBy("component", "part").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    side = F.shiftleft(F.pmod(F.xxhash64("v"), "parts"), FINE) + F.col("part")
    blocks = save(placed.join(parts, ["component", "part"]).select("component", side.alias("side"), "v", "copies", "vec"), "nn-blocks")
    runs = blocks.select("component", "side", "vec").repartition("component", "side").sortWithinPartitions("component", "side")
    centers = save(runs.mapInArrow(_centers, "component long, side long, center array<double>, radius double"), "nn-centers")
    one, two = (centers.select("component", *[F.col(c).alias(f"{c}_{x}") for c in ("side", "center", "radius")]) for x in "ab")
    cosine = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius_a") - F.col("radius_b")
    close = (F.col("side_a") == F.col("side_b")) | (apart <= float(np.arccos(threshold)) + 1e-6)
    facing = one.join(two, "component").where(close).groupBy("component", F.col("side_a").alias("side")).agg(F.collect_list("side_b").alias("others"))
    rows = blocks.join(facing, ["component", "side"]).select("component", "side", "v", "copies", "vec", F.explode("others").alias("other"))
    keyed = rows.select("component", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "v", "copies", "vec")
    runs = keyed.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    return runs.mapInArrow(lambda batches: _counts(batches, threshold), "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def _shares(points: DataFrame, chosen: DataFrame, size: int, counted: DataFrame, threshold: float) -> list[float]:
    """Of at most `size` of the chosen vectors, by a hash: the known share of the links of each that has links at all."""
    drawn = chosen.join(points.select("v", "vec"), "v").orderBy(F.xxhash64("v"), "v").limit(size).collect()
    by_dim: dict[int, tuple] = {}
    for d in {len(r["vec"]) for r in drawn}:
        some = [r for r in drawn if len(r["vec"]) == d]
        by_dim[d] = np.array([r["v"] for r in some]), np.array([r["vec"] for r in some])
    sent = points.sparkSession.sparkContext.broadcast(by_dim)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            ids, copies, sizes = batch.column("v").to_numpy(), batch.column("copies").to_numpy(), np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes) if len(ids) else []:
                if int(d) in sent.value:
                    rows = np.flatnonzero(sizes == d)
                    mat = lists.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)
                    of, q = sent.value[int(d)]
                    near = (q @ mat.T >= threshold) & (of[:, None] != ids[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(near @ copies[rows])], ["v", "links"])

    true = points.select("v", "copies", "vec").mapInArrow(held, "v long, links long").groupBy("v").agg(F.sum("links").alias("n_true")).where("n_true > 0")
    known = true.join(counted, "v", "left").select(F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n_true")).alias("share"))
    return [r["share"] for r in known.collect()]


def audit(points: DataFrame, counted: DataFrame, dense: DataFrame, threshold: float, linked: int = LINKED, audited: int = AUDITED) -> float:
    """Estimated mean share of a vector's links that is counted, vectors with links weighing alike.

    points (v, copies, vec), counted (v, links). Samples of bounded size are held against all vectors, and only counts
    come back: vectors with links inside saturated components, those outside, and those for which none are known,
    which stand for as many as they are. The lesser of the shares inside and outside is given.
    """
    some = counted.where("links > 0").select("v")
    inside, outside = some.join(dense.select("v"), "v", "left_semi"), some.join(dense.select("v"), "v", "left_anti")
    without = points.select("v").join(some, "v", "left_anti")
    means, n_outside, n_without = [], outside.count(), without.count()
    if shares := _shares(points, inside, linked, counted, threshold):
        means.append(sum(shares) / len(shares))
    known = sum(shares) / len(shares) * n_outside if (shares := _shares(points, outside, linked, counted, threshold)) else 0.0
    missed = len(_shares(points, without, audited, counted, threshold)) / max(1, min(audited, n_without)) * n_without
    if n_outside + missed:
        means.append(known / (n_outside + missed))
    return min(means, default=1.0)


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """One row (id, n_links, component_id, kept, recall) for each distinct id of vectors, a long.

    Vectors of cosine >= threshold, in doubles, are linked. n_links: other vectors linked directly; component_id:
    the least id reachable over links; kept: whether it is the vector's own. Null vectors, zero vectors, empty ones
    and those with null or non-finite components have no links; only vectors of the same length are compared. Equal
    vectors (up to length) are one point with copies. Of several rows of an id the least vector counts. A null id has
    one row without links. An empty table gives an empty one. The neighbour graph is approximate: links not found are
    missing, none is wrong. Rounds go on until the audit knows RECALL of the links or no further links come up; under
    LEAST_RECALL RuntimeError names the recall, else it stands in every row.
    """
    one = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("raw")).groupBy("id").agg(F.min("raw").alias("raw"))
    rounded = F.transform("vec", lambda c: F.round(c, 12))
    same = ("same_1", "same_2")  # 128 bits of the rounded components
    unit = usable(one, "id", "raw").select("id", F.xxhash64(rounded).alias("same_1"), F.xxhash64(F.lit(1), F.size("vec"), rounded).alias("same_2"), "vec")
    members = save(unit, "nn-members")
    points = save(members.groupBy(*same).agg(F.min("id").alias("v"), F.count("*").alias("copies"), F.min_by("vec", "id").alias("vec")).withColumn("last", F.lit(-2.0)), "nn-points")
    n = points.count()
    bits = min(24, max(1, int(np.ceil(np.log2(max(2, n) / 24)))))
    # the graph is built in single precision, which halves what moves; pairs that this leaves open are decided in doubles
    bare, weighed = points.select("v", "last", F.col("vec").cast("array<float>").alias("vec")), points.select("v", "copies", "vec")
    widest = points.agg(F.max(F.size("vec"))).first()[0] or 0
    copies = points.select(F.col("v").alias("u"), "copies")
    lists = None
    rounds, attempt, before = ROUNDS, 0, None
    while True:
        start = _buckets(bare if lists is None else _with_last(bare, lists), TABLES, bits, seed + attempt)
        lists = save(_merged(lists, _compared(_salted(start, "g", seed + attempt))), "nn-lists")
        for k in range(rounds):
            lists = _refined(bare, lists, threshold, seed + 100 * attempt + k)
        linked_pairs = linked = save(_decided(lists, weighed, threshold, 1e-6 + 2e-7 * (widest + 64)), "nn-linked")
        known = save(components(linked.select(F.col("v").alias("a"), F.col("u").alias("b")), "nn-components"), "nn-known")
        full = linked.groupBy("v").count().where(F.col("count") >= K).select("v")
        saturated = known.join(full.select(F.col("v").alias("node")), "node").select("component").distinct()
        dense = save(known.join(saturated, "component").select(F.col("node").alias("v"), "component"), "nn-dense")
        linked = linked.select("v", "u").union(linked.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
        sparse = linked.join(dense.select("v"), "v", "left_anti").join(copies, "u").groupBy("v").agg(F.sum("copies").alias("links"))
        counted = save(sparse.unionByName(_dense(weighed, dense, threshold, seed)), "nn-counts")
        recall = audit(weighed, counted, dense, threshold)
        if recall >= RECALL:
            break
        n_linked = linked_pairs.count()
        if before is not None and n_linked <= before:
            if recall >= LEAST_RECALL:
                break
            raise RuntimeError(f"near vectors: no further links came up in {attempt + 1} attempts, but the audit knows only {recall:.3f} of the links, under {LEAST_RECALL}")
        rounds, attempt, before = 1, attempt + 1, n_linked
    at_point = points.select(*same, "v", "copies").join(known.select(F.col("node").alias("v"), "component"), "v", "left").join(counted, "v", "left")
    found = members.select("id", *same).join(at_point, list(same)).select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "v").alias("component_id"))
    out = one.select("id").join(found, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"))
