"""Toxicity of documents: a factorization machine over hashed terms.

Terms are words and the beginnings of longer words, each present or absent. Besides a weight, a term has a short
vector; the product of two terms' vectors is the weight of both together, so an insult beside a group's name can
count where neither does alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bound_batches, held_out, labelled_sample, learned, list_views, string_slices, words

#: Terms are hashed to 2 ** BITS numbers. Documents learned from: at most MAX_ROWS, chosen by a hash of the id.
BITS, MAX_ROWS = 20, 20_000
#: Lengths in bytes of the beginnings of words; length of the vectors.
PREFIXES, FACTORS = (4, 5, 6), 4
#: Texts are taken apart in runs of about so many bytes; the arrays of a run are some fifty times as large.
RUN_BYTES = 1 << 18
#: From this score a document is rejected.
THRESHOLD = 0.7


@dataclass
class Model:
    """`slot` leads from a term's number to its row in `weights` and `vectors`; row 0 is that of terms without any."""

    slot: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of every word and beginning of a word of some rows; a row's terms may repeat."""
    h, row, _, begun = words(data, offsets, by_kind=True, prefixes=PREFIXES)
    return np.concatenate([h, *(x for x, _ in begun)]) >> np.uint64(64 - BITS), np.concatenate([row, *(x for _, x in begun)])


def _features(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in string_slices(batch.column("text"), RUN_BYTES):
            term, row = terms(data, offsets)
            code = np.unique(row << BITS | term.astype(np.int64))
            ends = np.searchsorted(code >> BITS, np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((code & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(first, end - first), batch.column("label").slice(first, end - first), lists], [id_col, "label", "terms"])


def learn(samples: list[tuple[np.ndarray, int]], *, alpha: float = 2.0, l1: float = 8.0, l2: float = 0.01, rate: float = 0.3, rounds: int = 6, lift: float = 3.0, least: int = 3, seed: int = 5) -> Model:
    """Fit to (terms, label) of each document, in a seeded order: weights by FTRL-proximal, vectors by AdaGrad.

    Documents of label 1 count `lift` times. Terms of fewer than `least` documents have no weight. Without samples every score is 0.5.
    A pair of a document of n terms weighs 1 / n; the step of a vector, decay included, is taken times the root of n.
    AdaGrad's sums start high: terms that stand in pairs by chance then stay near zero, those that always push one way grow.
    """
    counts = np.zeros(1 << BITS, np.int32)
    for t, _ in samples:
        counts[t] += 1
    used = np.flatnonzero(counts >= least)
    slot = np.zeros(1 << BITS, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    size = len(used) + 2  # row 0: terms without a weight; the last: the bias
    rng = np.random.default_rng(seed)
    z, n = np.zeros(size), np.zeros(size)
    v, vn = rng.normal(0, 0.1, (size, FACTORS)), np.full((size, FACTORS), 10.0)
    # the documents' slots, each with the bias at its end, lie in one array, which is given back whole
    flat, ends = np.empty(sum(len(t) + 1 for t, _ in samples), np.int32), [0]
    for t, _ in samples:
        s = slot[t]
        s = s[s > 0]
        at, end = ends[-1], ends[-1] + len(s) + 1
        flat[at : end - 1], flat[end - 1] = s, size - 1
        ends.append(end)
    slots = [flat[a:b] for a, b in zip(ends, ends[1:])]

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / alpha))

    for _ in range(rounds):
        for k in rng.permutation(len(samples)):
            i, label = slots[k], samples[k][1]
            w, vec = weight(i), v[i[:-1]]
            scale = 1 / np.sqrt(max(1, len(i) - 1))
            sums = vec.sum(0) * scale
            y = w.sum() + 0.5 * (sums @ sums - (vec * vec).sum() * scale * scale)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label) * (lift if label else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            if abs(g) > 1e-3:
                gv = g * (sums - vec * scale) + l2 * scale * vec
                vn[i[:-1]] += gv * gv
                v[i[:-1]] = vec - rate * gv / np.sqrt(vn[i[:-1]])
    w = weight(np.arange(size))
    pad = lambda x: np.concatenate([np.zeros_like(x[:1]), x[1:-1]]).astype(np.float32)
    return Model(slot, pad(w), pad(v), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most max_rows labelled documents that are not held out; their terms meet in one task."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col)
    schema = T.StructType([sample.schema[id_col]]).add("label", "integer").add("terms", T.ArrayType(T.IntegerType()))
    made = sample.mapInArrow(lambda batches: _features(batches, id_col), schema)
    return learned(made, id_col, lambda t: learn(list(zip(list_views(t["terms"]), t["label"].to_pylist())) if t else []))


def _score(model: Model, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for first, end, data, offsets in string_slices(column, RUN_BYTES):
        term, row = terms(data, offsets)
        s = model.slot[term]
        has = s > 0
        code = np.unique(row[has] << (BITS + 1) | s[has])
        row, s = code >> (BITS + 1), code & ((2 << BITS) - 1)
        n, size = end - first, np.maximum(1, np.bincount(row, minlength=end - first))
        y = model.bias + np.bincount(row, model.weights[s], n)
        for f in range(FACTORS):
            x = model.vectors[s, f]
            y += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)) / size
        out[first:end] = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
    return out


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with held_out, score and predicted; only the text makes the score.

    A null or empty text has the score of the bias alone. Texts of any length count whole. Rows that repeat, and rows
    of one id with different texts, are scored each by its text. An empty table gives an empty one. Columns of these
    names in docs are replaced. A null id is not held out.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_score(sent.value, batch.column(text_col)))], [*batch.schema.names, "score"])

    out = docs.mapInArrow(scored, T.StructType(list(docs.schema.fields)).add("score", "double"))
    flags = {"held_out": F.coalesce(held_out(id_col), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")}
    return out.withColumns(flags).select(*docs.columns, "held_out", "score", "predicted")
