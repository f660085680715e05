"""Quality of documents: hashed word n-gram logistic regression, learned by following the regularised leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import held_out, labelled_sample, learned, list_views, mix, string_slices, words

#: Weights: 2 ** BITS. Documents learned from: at most MAX_ROWS, chosen by a hash of the id.
BITS, MAX_ROWS = 18, 20_000
#: A document's terms have these frequencies, divided by its number of terms; times this number they are its values.
SCALE = 24.0
_SAME = np.uint64(0x5851F42D4C957F2D)
_NEXT = np.uint64(0xD1342543DE82EF95)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight index, row) of every word and pair of neighbouring words of some rows.

    Letters and signs are words of their own; a word twice in a row is one term, whatever the word.
    """
    h, row, _ = words(data, offsets, lower=False, by_kind=True)
    near = row[1:] == row[:-1]
    pair = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1] * _NEXT + h[1:]))[near]
    return (np.concatenate([h, pair]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[1:][near]])


def _features(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in string_slices(batch.column("text")):
            index, row = terms(data, offsets)
            code, times = np.unique(row << BITS | index, return_counts=True)
            ends = np.searchsorted(code >> BITS, np.arange(end - first + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
            out = [batch.column(id_col).slice(first, end - first), batch.column("label").slice(first, end - first), lists((code & ((1 << BITS) - 1)).astype(np.int32)), lists(times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, [id_col, "label", "terms", "times"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def learn(samples: list[tuple[np.ndarray, np.ndarray, int]], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, rounds: int = 3, seed: int = 5) -> Model:
    """Weights by FTRL-proximal over (terms, frequencies, label) of each document, in a seeded order.

    Without samples every score is 0.5; with one label only, that label's side.
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(samples)):
            index, times, label = samples[k]
            i = np.append(index, 1 << BITS)
            x = np.append(times * (SCALE / max(1, times.sum())), 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most max_rows labelled documents that are not held out; their terms meet in one task."""
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col)
    schema = T.StructType([sample.schema[id_col]]).add("label", "integer").add("terms", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.IntegerType()))
    made = sample.mapInArrow(lambda batches: _features(batches, id_col), schema)
    return learned(made, id_col, lambda t: learn(list(zip(list_views(t["terms"]), list_views(t["times"]), t["label"].to_pylist())) if t else []))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with held_out, score and predicted; only the text makes the score.

    A null or empty text has the score of the bias alone. Texts of any length count whole. Rows that repeat, and rows
    of one id with different texts, are scored each by its text. An empty table gives an empty one. Columns of these
    names in docs are replaced. A null id is not held out.
    """
    docs = docs.drop("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, end, data, offsets in string_slices(batch.column(text_col)):
                index, row = terms(data, offsets)
                total = np.bincount(row, model.weights[index], end - first)
                y = model.bias + SCALE * total / np.maximum(1, np.bincount(row, minlength=end - first))
                out[first:end] = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    out = docs.mapInArrow(scored, T.StructType(list(docs.schema.fields)).add("score", "double"))
    flags = {"held_out": F.coalesce(held_out(id_col), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")}
    return out.withColumns(flags).select(*docs.columns, "held_out", "score", "predicted")
