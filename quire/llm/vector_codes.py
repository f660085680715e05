"""Product-quantised codes of vectors, in exact integers, with annular norm pruning.

A vector is cut into equal parts; each part position has a codebook of a few entries, and a code names the nearest
entry of each part. Finding it: the entries of a codebook lie sorted by norm. By the triangle inequality an entry can
be as near as the best one so far only if its norm lies within that distance of the part's norm. So a binary search
gives the annulus of entries that the best distance allows, its edges included; the entries within are evaluated
exactly, those of the nearest norm first, and the annulus shrinks as better ones are found.

Norms are doubles and the annulus is widened by far more than their error; distances are integers, of 64 bits where
the components are small enough that none can overflow and of any size elsewhere.

Codebooks are learned in rounds. Each round reads the vectors where they are; a task hands on one partial sum for
each entry, and the driver gets codebooks only, whose size doesn't depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import save

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by before it is rounded down.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a batch that are worked on at once.
ROWS = 8192
#: Largest components with which squared differences of up to 2,048 positions add up within 64 bits.
_SMALL = 1 << 25
#: Components from which squares are too large for doubles: no annulus there, all entries are evaluated.
_HUGE = 1 << 500
#: Sums travel in digits of so many bits, so that no column overflows: 2 ** 30 tasks may add theirs. So many digits
#: hold any sum of single precision numbers, and of doubles.
_LIMB_BITS, _LIMBS, _LIMBS_DOUBLE = 32, 8, 36
_MOST = (1 << 63) - 1


@dataclass
class Codebook:
    """Entries of one part position: as they are numbered, and their numbers and norms in order of the norm."""

    entries: np.ndarray
    order: np.ndarray
    norms: np.ndarray


def codebook(entries: np.ndarray) -> Codebook:
    with np.errstate(over="ignore"):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    return Codebook(entries, order, norms[order])


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64 bits where the largest allows it, Python's integers elsewhere."""
    if not vectors.size or np.abs(vectors).max() <= _SMALL / scale:
        return np.floor(vectors * float(scale)).astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return np.array([exact(float(v)) for v in vectors.ravel()], object).reshape(vectors.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(1)


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row, of several the one of the lowest number."""
    n, size = len(x), len(book.order)
    entries = book.entries if x.dtype == book.entries.dtype else book.entries.astype(object)
    if entries.dtype == object and book.norms[-1] + np.abs(x).max(initial=0) >= _HUGE:
        every = np.stack([squared(x, entries[e : e + 1]) for e in range(size)], 1)
        best = every.argmin(1)
        return best, every[np.arange(n), best]
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    # the entry of the nearest norm first
    at = np.minimum(np.searchsorted(book.norms, norm), size - 1)
    before = np.maximum(at - 1, 0)
    at = np.where(np.abs(book.norms[before] - norm) < np.abs(book.norms[at] - norm), before, at)
    best = book.order[at].copy()
    far = squared(x, entries[best])
    low, high = np.zeros(n, np.int64), np.full(n, size, np.int64)

    def annulus(rows: np.ndarray) -> None:
        """Entries from low up to high have a norm that the best distance allows."""
        reach = np.sqrt(far[rows].astype(np.float64))
        slack = 1e-9 * (norm[rows] + reach) + 1e-6
        low[rows] = np.searchsorted(book.norms, norm[rows] - reach - slack, "left")
        high[rows] = np.searchsorted(book.norms, norm[rows] + reach + slack, "right")

    rows = np.arange(n)
    annulus(rows)
    left, right = at - 1, at + 1  # what lies between them has been evaluated
    while len(rows := rows[(left[rows] >= low[rows]) | (right[rows] < high[rows])]):
        can_left, can_right = left[rows] >= low[rows], right[rows] < high[rows]
        gap_left = np.where(can_left, np.abs(norm[rows] - book.norms[np.maximum(left[rows], 0)]), np.inf)
        gap_right = np.where(can_right, np.abs(book.norms[np.minimum(right[rows], size - 1)] - norm[rows]), np.inf)
        go_left = gap_left <= gap_right
        place = np.where(go_left, left[rows], right[rows])
        left[rows] -= go_left
        right[rows] += ~go_left
        entry = book.order[place]
        d = squared(x[rows], entries[entry])
        better = (d < far[rows]) | ((d == far[rows]) & (entry < best[rows]))
        won = rows[better]
        best[won], far[won] = entry[better], d[better]
        annulus(won)
    return best, far


def whole(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Which lists hold finite numbers only and, if dims is given, so many."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten()
    bad = ~np.isfinite(values.to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(column)), np.maximum(sizes, 0))
    good = (sizes >= 0) & (np.bincount(row[bad], minlength=len(column)) == 0)
    return good & (sizes == dims) if dims is not None else good


def parts_of(batch: pa.RecordBatch, dims: int, parts: int, scale: int, vec_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, integers by row, part, position) of the whole vectors of a batch, ROWS at a time."""
    width = -(-dims // parts)
    batch = batch.filter(pa.array(whole(batch.column(vec_col), dims)))
    for first in range(0, batch.num_rows, ROWS):
        some = batch.slice(first, ROWS)
        x = np.zeros((some.num_rows, width * parts))
        x[:, :dims] = some.column(vec_col).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dims)
        yield some, integers(x, scale).reshape(some.num_rows, parts, width)


def limbs(value: int, n: int) -> list[int]:
    """A number in n digits of _LIMB_BITS bits, the last of them with the sign."""
    mask = (1 << _LIMB_BITS) - 1
    return [(value >> (_LIMB_BITS * k)) & mask for k in range(n - 1)] + [value >> (_LIMB_BITS * (n - 1))]


def first_vectors(vectors: DataFrame, entries: int, id_col: str, vec_col: str) -> list[list[float]]:
    """The vectors of the smallest ids that are whole, in order; a null id comes last, of one id the least vector first.

    Their dimension is that of the first.
    """
    usable = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.where(usable).select(id_col, vec_col)
    order = [F.asc_nulls_last(id_col), F.asc(vec_col)]
    one = some.orderBy(*order).limit(1).collect()
    if not one:
        return []
    dims = len(one[0][vec_col])
    return [r[vec_col] for r in some.where(F.size(vec_col) == dims).orderBy(*order).limit(entries).collect()]


def learn(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[list[np.ndarray], int]:
    """The codebook of each part position, as an array of integers by entry and position, and the vectors' dimension.

    Without vectors there are none, and the dimension is -1.

    Each round assigns every part to its nearest entry and replaces an entry by the componentwise mean of its parts,
    rounded down; entries without parts stay.
    """
    spark = vectors.sparkSession
    start = first_vectors(vectors, entries, id_col, vec_col)
    if not start:
        return [], -1
    dims = len(start[0])
    n_limbs = _LIMBS_DOUBLE if vectors.schema[vec_col].dataType.elementType == T.DoubleType() else _LIMBS
    width = -(-dims // parts)
    padded = np.zeros((len(start), width * parts))
    padded[:, :dims] = np.array(start, np.float64).reshape(len(start), dims)
    books = list(integers(padded, scale).reshape(len(start), parts, width).swapaxes(0, 1))
    for _ in range(rounds if width else 0):
        sent = spark.sparkContext.broadcast([codebook(b) for b in books])

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, len(start), width), object)
            counts = np.zeros((parts, len(start)), np.int64)
            for batch in batches:
                for _, x in parts_of(batch, dims, parts, scale, vec_col):
                    for p, book in enumerate(sent.value):
                        best, _ = nearest(x[:, p], book)
                        counts[p] += np.bincount(best, minlength=len(start))
                        part = np.zeros((len(start), width), x.dtype)
                        np.add.at(part, best, x[:, p])
                        sums[p] += part
            p, e = np.nonzero(counts)
            digits = [[limbs(int(v), n_limbs) for v in sums[a, b]] for a, b in zip(p, e)]
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(digits, kind)], ["part", "entry", "n", "digits"])

        told = vectors.select(vec_col).mapInArrow(partial, "part int, entry int, n long, digits array<array<long>>")
        cells = told.select("part", "entry", "n", F.posexplode("digits").alias("position", "digits"))
        added = [F.sum(F.col("digits")[k]).alias(f"d{k}") for k in range(n_limbs)]
        new = [b.astype(object) for b in books]
        for r in cells.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), *added).collect():  # one number of a codebook each
            new[r["part"]][r["entry"], r["position"]] = sum(r[f"d{k}"] << (_LIMB_BITS * k) for k in range(n_limbs)) // r["n"]
        sent.unpersist()
        small = all(abs(int(v)) <= _SMALL for b in new for v in b.ravel())
        books = [b.astype(np.int64) for b in new] if small else new
    return books, dims


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], dims: int, *, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every whole vector of `dims` components, by codebooks that `learn` gave.

    code has two hexadecimal digits for each part, error is the sum of squared distances, at most 2 ** 63 - 1.
    """
    parts = max(1, len(books))
    sent = vectors.sparkSession.sparkContext.broadcast([codebook(b) for b in books])
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("label", vectors.schema[label_col].dataType)]).add("code", "string").add("error", "long")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in parts_of(batch, dims, parts, scale, "vector"):
                code = np.zeros((len(x), parts), np.uint8)
                error = np.zeros(len(x), object)
                for p, book in enumerate(sent.value if x.shape[2] else []):
                    best, far = nearest(x[:, p], book)
                    code[:, p] = best
                    error += far
                told = [pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([min(int(v), _MOST) for v in error], pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), *told], ["id", "label", "code", "error"])

    return rows.mapInArrow(coded, schema)


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row for each whole vector.

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another dimension
    than the vector of the smallest id has; a dimension that `parts` doesn't divide is filled up with zeros. Each
    component x counts as floor(scale * x). Codebooks start as the parts of the vectors of the `entries` smallest ids
    (a null id last, of rows of one id the least vector first) and are learned in `rounds` rounds; at most 256
    entries. Of entries equally near the lowest number is taken. label_error adds up the errors of equal labels,
    nulls together, at most 2 ** 63 - 1. Repeated rows stay, each with its code. Other columns are left out, whatever
    their names. An empty table gives an empty one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has room for 1 to 256 entries")
    settings = dict(scale=scale, id_col=id_col, vec_col=vec_col)
    books, dims = learn(vectors, parts=parts, entries=entries, rounds=rounds, **settings)
    done = save(encode(vectors, books, dims, label_col=label_col, **settings), "vector-codes")
    # added up in the tasks before rows move; the way back is a join whose large partitions are split
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    labels = done.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    out = done.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
