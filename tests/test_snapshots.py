"""Collections as snapshots, chunk JSON both ways, k-NN in tiles, keywords by postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import collection, context, rerank, search
from quire.sources import files, snapshots

SCHEMA = "id string, document string"


def ids(spark, path, name, version=None):
    return sorted(r["id"] for r in snapshots.load(spark, path, name, version).collect())


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.names(spark, path) == [] and snapshots.stats(spark, path).count() == 0
    with pytest.raises(KeyError):
        snapshots.load(spark, path, "a")
    snapshots.replace(spark.createDataFrame([("1", "x"), ("2", "y")], SCHEMA), path, "a")
    snapshots.replace(spark.createDataFrame([("1", "z")], SCHEMA), path, "b")
    snapshots.add(spark.createDataFrame([("3", "w")], SCHEMA), path, "a")
    assert ids(spark, path, "a") == ["1", "2", "3"] and ids(spark, path, "b") == ["1"]
    snapshots.upsert(spark.createDataFrame([("2", "new", 1), ("4", "v", 2), ("4", "last", 3)], SCHEMA + ", position int"), path, "a")
    assert sorted(map(tuple, snapshots.load(spark, path, "a").collect())) == [("1", "x"), ("2", "new"), ("3", "w"), ("4", "last")]
    # the last entry goes: the collection stays, empty and with its columns
    snapshots.delete(spark.createDataFrame([("1",)], "id string"), path, "b")
    assert ids(spark, path, "b") == [] and snapshots.names(spark, path) == ["a", "b"]
    version = snapshots.reset(spark, path, "a")
    assert ids(spark, path, "a") == [] and snapshots.load(spark, path, "a").columns == ["id", "document"]
    assert ids(spark, path, "a", version - 1) == ["1", "2", "3", "4"]
    assert sorted(map(tuple, snapshots.stats(spark, path).collect())) == [("a", 0, "cosine"), ("b", 0, "cosine")]
    snapshots.drop(spark, path, "b")
    assert snapshots.names(spark, path) == ["a"]
    snapshots.vacuum(spark, path)
    assert list((tmp_path / "store" / "data").iterdir()) == []
    snapshots.add(spark.createDataFrame([("5", "q")], SCHEMA), path, "a")
    assert ids(spark, path, "a") == ["5"]


def test_killed_and_concurrent_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    snapshots.replace(spark.createDataFrame([("1", "x")], SCHEMA), path, "a")
    before = snapshots.manifest(spark, path)
    # killed between the folder and the manifest: readers see what was there, the next job goes on
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            snapshots.replace(spark.createDataFrame([("2", "y")], SCHEMA), path, "a")
    assert ids(spark, path, "a") == ["1"]
    snapshots.replace(spark.createDataFrame([("3", "y")], SCHEMA), path, "a")
    with pytest.raises(snapshots.Conflict):  # a writer that read an older version
        snapshots.replace(spark.createDataFrame([("4", "y")], SCHEMA), path, "a", before=before)
    assert ids(spark, path, "a") == ["3"]
    assert len(snapshots.vacuum(spark, path)) == 3 and ids(spark, path, "a") == ["3"]


def test_emptied_collection_goes(spark, tmp_path):
    path, staging = str(tmp_path / "c"), str(tmp_path / "s")
    first = spark.createDataFrame([("c0", "1"), ("c1", "2")], "collection string, id string")
    files.write_collection(first, path)
    entries = spark.read.schema(first.schema).parquet(path)
    files.rewrite_collection(collection.reset(entries, "c0"), path, staging, names=["c0", "c1"])
    assert [(r["collection"], r["id"]) for r in spark.read.schema(first.schema).parquet(path).collect()] == [("c1", "2")]


def test_chunk_json_back(spark, tmp_path):
    rows = [(1, "chunk_0001", "a\nb", None, [0.5, 1.5]), (2, "chunk_0001", "", 3, None)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id string, content string, page int, embedding array<float>")
    files.write_chunk_json(chunks, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_chunk_lines(spark, str(tmp_path / "j"), chunks.schema).collect())) == rows
    index = files.write_embeddings(chunks, str(tmp_path / "v"), as_json=True)
    assert index.count() == 2 and sorted(map(tuple, files.read_chunk_lines(spark, str(tmp_path / "v"), chunks.schema).collect())) == rows


@pytest.mark.parametrize("metric", search.METRICS)
def test_tiles_give_the_same_rows(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    vectors = lambda n: [[float(x) for x in v] for v in np.round(rng.normal(size=(n, 6)), 1)]  # noqa: E731  many equal distances
    entries = spark.createDataFrame([(f"e{i}", v, f"c{i % 3}") for i, v in enumerate(vectors(300))], "id string, embedding array<float>, collection string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(vectors(70))), "query_id long, embedding array<float>").repartition(3)
    state = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    run = lambda: (state(search.knn(queries, entries, 4, metric)), state(search.similar_entries(queries, entries, 0.9)), state(search.multi_collection(queries, entries, ["c0", "c2"], 2)))
    sent = run()
    assert sent[0] == state(search.knn_columns(queries, entries, 4, metric)) and len(sent[2]) == 70 * 4
    monkeypatch.setattr(search, "QUERY_NUMBERS", 0)
    monkeypatch.setattr(search, "TILE_QUERIES", 16)
    monkeypatch.setattr(search, "TILE_ENTRIES", 50)
    assert run() == sent
    assert search.knn(queries.limit(0), entries).count() == 0 and search.knn(queries, entries.limit(0)).count() == 0


def test_keywords_by_postings(spark, monkeypatch):
    monkeypatch.setattr(search, "KEY_CHARS", 5)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    texts = [(f"d{i}", " ".join(word() for _ in range(12)) if i else None) for i in range(40)]
    asked = [(i, " ".join(word() for _ in range(4))) for i in range(15)] + [(98, ""), (99, "aa AA")]
    got = search.keyword_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(texts, "id string, content string"), 50)
    want = set()
    for q, text in asked:
        for i, t in texts:
            n = sum((t or "").count(w) for w in text.lower().split())
            if n:
                want.add((q, i, n))
    assert {(r["query_id"], r["id"], r["score"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_four_places_as_python_prints_them(spark):
    rng = random.Random(5)
    values = [k / 1e5 for k in range(0, 100001, 5) if k % 10 == 5][:4000] + [rng.random() for _ in range(2000)] + [0.0, 1.0, -0.04955, 12.00005, 3.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", context.four_places(F.col("x")).alias("t")).collect()
    assert [r for r in got if r["t"] != f"{r['x']:.4f}"] == []


def test_improvement_with_ties(spark):
    rows = [(1, 0.000001, 0.0), (1, 0.000002, 0.0), (2, 0.0, 0.000001), (2, 0.0, 0.000002)]
    got = rerank.rerank_improvement(spark.createDataFrame(rows, "query_id long, rerank_score double, original_score double")).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, 0.000002, 0.000002), (2, -0.000002, -0.000001)]
