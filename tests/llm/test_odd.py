"""Empty files, empty partitions and rows of nulls through every operator; scores by plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, embedding_dedup, line_dedup, minhash, mixing, quality, suffix_dedup, token_counts, toxicity, url_filter

DOCS, LABELS, ITEMS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int", "item_id long, text string"
TEXTS = [(1, "one two three four five six seven eight", "a"), (1, "one two three four five six seven eight", "a"), (None, None, None), (None, "x", "b"), (2, "", None), (3, "y " * 5000, "b")]


def tokens(docs, labels, items):
    P = pytest.importorskip("public_tokenizers")
    return token_counts.token_counts(docs, P.path("piece_bpe_32k.model"))


OPERATORS = {
    "op2": lambda docs, labels, items: suffix_dedup.dedup_passages(docs),
    "op3": lambda docs, labels, items: minhash.near_duplicates(docs),
    "op4": lambda docs, labels, items: line_dedup.line_dedup(docs),
    "op5": tokens,
    "op6": lambda docs, labels, items: mixing.mix(docs),
    "op7": lambda docs, labels, items: toxicity.score(docs, toxicity.fit(docs, labels)),
    "op9": lambda docs, labels, items: decontamination.contamination(docs, items),
    "op10": lambda docs, labels, items: quality.score(docs, quality.fit(docs, labels)),
}


def stored(spark, path, rows, schema, parts):
    """A table of files, some of them without rows, so that tasks with none run."""
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(path))
    return spark.read.schema(schema).parquet(str(path)).repartition(parts)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_and_null_rows(spark, tmp_path, name):
    labels = stored(spark, tmp_path / "labels", [(1, 1, 0), (None, None, None), (7, 0, 1)], LABELS, 3)
    items = stored(spark, tmp_path / "items", [(1, "one two three four five"), (None, None), (2, "")], ITEMS, 3)
    none = stored(spark, tmp_path / "none", [], DOCS, 3)
    assert OPERATORS[name](none, labels.where("doc_id > 99"), items.where("item_id > 99")).collect() == []
    some = stored(spark, tmp_path / "some", TEXTS, DOCS, 9)
    got = OPERATORS[name](some.withColumns({"run": F.lit(1), "part": F.lit("x"), "leaks": F.lit(2)}), labels, items).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, -1, 1, 1, 2, 3]


def test_empty_vectors_and_urls(spark, tmp_path):
    vectors = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_vectors(stored(spark, tmp_path / "v0", [], vectors, 3)).collect() == []
    got = embedding_dedup.near_vectors(stored(spark, tmp_path / "v", [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None)], vectors, 6)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in got) == [(-1, 0, True), (1, 1, True), (2, 1, False), (3, 0, True)]
    urls = "page_id long, url string"
    assert url_filter.judge(stored(spark, tmp_path / "u0", [], urls, 3)).collect() == []
    got = url_filter.judge(stored(spark, tmp_path / "u", [(1, None), (None, "http://a.org/x"), (None, "http://a.org/x")], urls, 6)).collect()
    assert sorted((r["page_id"] or -1, r["rule"] or "-", r["verdict"]) for r in got) == [(-1, "org/", "allow"), (-1, "org/", "allow"), (1, "-", "allow")]


@pytest.fixture(scope="module")
def judged():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) + (" awful!!" if k % 3 == 0 else "") for k in range(400)]
    return texts, [int(k % 3 == 0) for k in range(400)]


def test_pair_scores_by_hand(judged):
    """The factorization machine's score from its weights and vectors, pair by pair."""
    texts, labels = judged
    sample = []
    for t, y in zip(texts, labels):
        term, _ = toxicity.terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        sample.append((np.unique(term.astype(np.int64)), y))
    model = toxicity.learn(sample)
    import pyarrow as pa

    got = toxicity._score(model, pa.array(texts[:40]))
    for k in range(40):
        s = [int(x) for x in np.unique(model.slot[sample[k][0]]) if x]
        y = model.bias + sum(float(model.weights[i]) for i in s)
        y += sum(float(model.vectors[a] @ model.vectors[b]) for n, a in enumerate(s) for b in s[:n]) / max(1, len(s))
        assert math.isclose(got[k], 1 / (1 + math.exp(-y)), abs_tol=1e-5)
