"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make the whole signature: the first scatters a document's shingles, the
second, shifted round by one place for each coordinate, gives the coordinate's order. Coordinates are banded;
documents with an equal band are candidates, and shared shingles of the full sets decide.

Documents with the same set are one class. In a bucket each class is compared with the bucket's least one, and where that
leaves it out, with the one nearest to it. Once components are known, only classes of different components that still
share a bucket are compared: in small buckets by pairs, in large ones block by block. So a large group of copies
costs a comparison or two for each and never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bound_batches, components, mix, save, string_slices, words

SHINGLE = 5
#: 20 bands of 6 coordinates find a pair of similarity 0.85 with probability 0.9999, one of 0.8 with 0.998.
BANDS, ROWS = 20, 6
#: Buckets of up to so many classes are compared by pairs, larger ones in blocks of so many.
PAIRED, BLOCK = 32, 256
#: Pairs of one document that are compared in one place.
DEALT = 256
_ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of the distinct shingles of some rows, by row and in order of their hashes.

    A row of fewer than five words has one shingle, all its words; a row without words none.
    """
    h, row, counts = words(data, offsets)
    n = len(h)
    if not n:
        return h, row
    ends = np.cumsum(counts)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = h[k:]
        part[np.arange(n) + k >= ends[row]] = 0  # words past the row's end
        total += part * _ORDER[k]
    full = np.arange(n) + SHINGLE <= ends[row]
    first = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    short = first & (counts[row] < SHINGLE)
    keep = full | short
    s, r = mix(total[keep] + np.minimum(counts[row[keep]], SHINGLE).astype(np.uint64)), row[keep]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], r[new]


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _order(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers, in place."""
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    x ^= x >> np.uint32(15)
    return x


def signatures(s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Coordinates (row, k) of the rows that begin at `starts`: the least place, in the order shifted by k."""
    out = np.empty((len(starts), size), np.uint32)
    x = _scatter((s >> np.uint64(32)).astype(np.uint32))
    block = 1 << 16
    edges = [0]
    while edges[-1] < len(starts):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + block, "right")) - 1))
    edges[-1] = len(starts)
    for a, b in zip(edges, edges[1:]):
        stop = starts[b] if b < len(starts) else len(s)
        part, at = x[starts[a] : stop], starts[a:b] - starts[a]
        for k in range(size):
            out[a:b, k] = np.minimum.reduceat(_order(part + np.uint32(k)), at)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_shingles", "k1", "k2", "bands"]
    for batch in batches:
        for first, end, data, offsets in string_slices(batch.column(text_col)):
            s, row = shingles(data, offsets)
            n = end - first
            sizes = np.bincount(row, minlength=n)
            some = np.flatnonzero(sizes)
            bands = np.zeros((n, BANDS), np.int64)
            keys = np.zeros((2, n), np.uint64)
            if len(some):
                starts = np.searchsorted(row, some)
                signed = signatures(s, starts, BANDS * ROWS).astype(np.uint64).reshape(len(some), BANDS, ROWS)
                code = np.zeros((len(some), BANDS), np.uint64)
                for k in range(ROWS):
                    code = mix(code + signed[:, :, k] + np.uint64(k + 1))
                bands[some] = mix(code + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                keys[0, some] = np.add.reduceat(mix(s), starts)
                keys[1, some] = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            ends = np.append(0, np.cumsum(np.where(sizes > 0, BANDS, 0)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(first, n), pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], names)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, k1, k2, bands) of every row; equal k1 and k2 mean equal sets."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("n_shingles", "long").add("k1", "long").add("k2", "long").add("bands", T.ArrayType(T.LongType()))
    return docs.select(id_col, text_col).mapInArrow(lambda batches: _sketch(batches, id_col, text_col), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in string_slices(batch.column("text")):
            s, row = shingles(data, offsets)
            ends = np.searchsorted(row, np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(first, end - first), lists], ["rep", "shingles"])


def full_sets(needed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) of every row of docs whose id is needed and that has a set: the whole set.

    The ids grow with the corpus, so they are not broadcast at any size: texts move to them once, unsorted.
    """
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(needed.hint("shuffle_hash"), "rep")
    schema = T.StructType([texts.schema["rep"]]).add("shingles", T.ArrayType(T.LongType()))
    return texts.select("rep", "text").mapInArrow(_sets, schema).where(F.size("shingles") > 0)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, size_a, size_b) of rows (b, part, own, rep, shingles), b's own sets first in each part."""
    last, held = None, []
    for batch in batches:
        b, part, own, rep = (batch.column(name).to_pylist() for name in ("b", "part", "own", "rep"))
        lists = batch.column("shingles")
        values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
        out: list[tuple] = []
        for i in range(batch.num_rows):
            mine = values[ends[i] : ends[i + 1]]
            if (b[i], part[i]) != last:
                last, held = (b[i], part[i]), []
            if own[i]:
                held.append(mine.copy())
                continue
            for theirs in held:
                at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                out.append((rep[i], b[i], int((theirs[at] == mine).sum()), len(mine), len(theirs)))
        kinds = (batch.schema.field("rep").type, batch.schema.field("b").type, pa.int64(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "shared", "size_a", "size_b"])


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, shared, size_a, size_b, linked): the exact comparison of the whole sets of each pair of ids.

    Each pair moves one set, a's, to where b is; b's own moves once for each DEALT pairs, between which many pairs of
    one b are dealt. Of several rows of an id the pair whose sets share most counts.
    """
    dealt = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    asks = pairs.join(dealt, "b").select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(0).alias("own"), F.col("a").alias("rep"))
    own = dealt.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("own"), F.col("b").alias("rep"))
    # written first, so that what moves is planned from its size
    asks = save(asks.unionByName(own), "minhash-asks")
    rows = asks.join(sets, "rep").select("b", "part", "own", "rep", "shingles").repartition("b", "part").sortWithinPartitions("b", "part", F.desc("own"))
    schema = T.StructType([T.StructField("a", sets.schema["rep"].dataType), T.StructField("b", sets.schema["rep"].dataType)]).add("shared", "long").add("size_a", "long").add("size_b", "long")
    counted = rows.mapInArrow(_compared, schema)
    share = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    best = counted.groupBy("a", "b").agg(F.max_by(F.struct("shared", "size_a", "size_b"), share).alias("s")).select("a", "b", "s.*")
    return best.withColumn("linked", 100 * F.col("shared") >= per_cent * (F.col("size_a") + F.col("size_b") - F.col("shared")))


def _held_against(rows: pa.Table, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of the asking rows to the rows of a block, one for each other component that a row meets."""
    ask = rows["ask"].to_numpy()
    ids, group = rows["rep"].to_numpy(), rows["component"].to_numpy()
    column = rows["shingles"].combine_chunks()
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    members = np.flatnonzero(~ask)
    sizes = np.diff(ends)
    held = np.concatenate([values[ends[i] : ends[i + 1]] for i in members]) if len(members) else values[:0]
    of = np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(held, kind="stable")
    held, of = held[order], of[order]
    a, b = [], []
    for i in np.flatnonzero(ask):
        mine = values[ends[i] : ends[i + 1]]
        low, high = np.searchsorted(held, mine), np.searchsorted(held, mine, "right")
        times = high - low
        at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        shared = np.bincount(of[at], minlength=len(members))
        near = 100 * shared >= per_cent * (sizes[i] + sizes[members] - shared)
        met = members[near & (group[members] != group[i])]
        one = met[np.unique(group[met], return_index=True)[1]]
        a.append(np.full(len(one), ids[i]))
        b.append(ids[one])
    none = ids[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _block_links(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done():
        a, b = _held_against(pa.Table.from_batches(held), per_cent)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("bucket", "block", "part")])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for x, y in zip([0, *new], [*new, batch.num_rows]):
            part = batch.slice(x, y - x)
            if held and part.num_rows and any(held[-1].column(name)[0] != part.column(name)[0] for name in ("bucket", "block", "part")):
                yield done()
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield done()


def block_links(apart: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): links between components within large buckets (bucket, n_reps, main, rep, component).

    A bucket's classes are dealt into blocks; those outside its main component, dealt into parts of the same size, are
    held against every block. What comes out are links, at most one for a class and another component of a block.
    """
    asks = F.col("component") != F.col("main")
    shares = apart.groupBy("bucket").agg(F.ceil(F.count(F.when(asks, 1)) / BLOCK).cast("int").alias("parts"))
    placed = apart.join(shares, "bucket").withColumn("blocks", F.ceil(F.col("n_reps") / BLOCK).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), n).cast("int")
    own = placed.select("bucket", "rep", "component", F.lit(False).alias("ask"), one(1, "blocks").alias("block"), every("parts").alias("part"))
    ask = placed.where(asks).select("bucket", "rep", "component", F.lit(True).alias("ask"), every("blocks").alias("block"), one(2, "parts").alias("part"))
    dealt = save(own.unionByName(ask.select(*own.columns)), "minhash-blocks")
    rows = dealt.join(sets, "rep").repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part")
    rows = rows.select("bucket", "block", "part", "rep", "component", "ask", "shingles")
    schema = T.StructType([T.StructField("a", sets.schema["rep"].dataType), T.StructField("b", sets.schema["rep"].dataType)])
    return rows.mapInArrow(lambda batches: _block_links(batches, per_cent), schema)


def near_duplicates(docs: DataFrame, *, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if their sets of shingles have a Jaccard similarity of per_cent / 100 or more. n_shingles
    is the size of the set, component_id the least id reachable over links, itself included, kept whether they are
    equal. Null texts and texts without words have no shingles and no links. Rows of one id are one document for
    the links, whatever else some of its rows hold; a null id has no links. Very long texts count whole. Other columns
    of docs are left out, whatever their names. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    sketch = save(sketches(docs, id_col, text_col), "minhash-sketches")
    some = sketch.where("n_shingles > 0 and id is not null")
    classes = save(some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.min_by("bands", "id").alias("bands")), "minhash-classes")
    members = some.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    bucket = save(classes.select("rep", "n", F.explode("bands").alias("bucket")), "minhash-buckets")
    least = bucket.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("lead"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("bucket", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    placed = save(bucket.join(least, "bucket"), "minhash-placed")
    fits = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * per_cent  # noqa: E731  else the sizes alone decide
    sets = save(full_sets(placed.select("rep").distinct(), docs, id_col, text_col), "shingle-sets")
    first = placed.where((F.col("rep") != F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    checked = save(verified(first, sets, per_cent), "minhash-verified")
    # how far a class is from its bucket's least one; unknown where the sizes alone keep them apart
    far = checked.select(F.col("a").alias("rep"), F.col("b").alias("lead"), "linked", (1 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("far"))
    is_lead = F.col("rep") == F.col("lead")
    placed = save(placed.join(far, ["rep", "lead"], "left").withColumns({"far": F.when(is_lead, 0.0).otherwise(F.col("far")), "linked": is_lead | F.coalesce("linked", F.lit(False))}), "minhash-far")
    # a second comparison, of those left out with the class nearest to the bucket's least one
    nearest = F.min_by(F.struct("rep", "n"), F.when(F.col("linked") & ~is_lead, F.col("far")))
    pivots = placed.groupBy("bucket").agg(nearest.alias("pivot")).where("pivot is not null").select("bucket", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    second = placed.where(~F.col("linked")).join(pivots, "bucket").where(fits(F.col("n"), F.col("pivot_n"))).select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    links = checked.where("linked").select("a", "b").union(verified(second, sets, per_cent).where("linked").select("a", "b"))
    known = save(components(links, "minhash-components"), "minhash-known")
    as_links = lambda df: df.select(F.col("node").alias("a"), F.col("component").alias("b"))
    # the buckets that still hold several components: with their size and their least one's component
    now = placed.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n_reps"), F.min_by("component", "rep").alias("main")).where("x <> y")
    apart = save(now.join(several.drop("x", "y"), "bucket"), "minhash-apart")
    # what is left: pairs in small buckets, blocks in large ones
    limit = 1 - per_cent / 100 + 1e-9
    small = apart.where(F.col("n_reps") <= PAIRED)
    a = small.select("bucket", F.col("rep").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"), F.col("far").alias("far_a"))
    b = small.select("bucket", F.col("rep").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"), F.col("far").alias("far_b"))
    near = (F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) <= limit, F.lit(True)) & fits(F.col("n_a"), F.col("n_b"))
    rest = save(a.join(b, "bucket").where(near).select("a", "b").distinct(), "minhash-rest")
    more = verified(rest, sets, per_cent).where("linked").select("a", "b")
    blocks = block_links(apart.where(F.col("n_reps") > PAIRED), sets, per_cent)
    every = as_links(known).union(more).union(blocks).union(members)
    found = components(every, "minhash-components")
    out = sketch.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
