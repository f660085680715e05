"""Approximate k-NN by codes: recall, an index that takes new entries, tiles and blocks of any size."""

import os

import numpy as np
import pytest

from quire.operators import ann, search
from quire.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"


def data(spark, n=3000, dims=18):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(30, dims))[rng.integers(0, 30, n)] + rng.normal(size=(n, dims)) * 0.6).astype(np.float32)
    return spark.createDataFrame([(f"e{i}", v) for i, v in enumerate(x.tolist())], "id string, embedding array<float>").repartition(4), spark.createDataFrame([(i, v) for i, v in enumerate(x[:60].tolist())], "query_id long, embedding array<float>")


pairs = lambda df: {(r["query_id"], r["id"]) for r in df.select("query_id", "id").collect()}
state = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "distance").collect()))


def test_recall_and_index(spark, tmp_path, monkeypatch):
    entries, queries = data(spark)
    exact = pairs(search.knn(queries, entries))
    path = str(tmp_path / "index")
    model = ann.write_index(entries, path)
    assert model.cells == 54  # the root of the rows
    found = state(ann.search_index(queries, path, probed=0.3))
    assert len({(r[0], r[2]) for r in found} & exact) >= 0.95 * len(exact)
    assert found == state(ann.knn_quantised(queries, entries, probed=0.3))
    monkeypatch.setattr(ann, "TILE_CODES", 20)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    assert state(ann.search_index(queries, path, probed=0.3)) == found
    # every code is a candidate: the exact rows
    assert state(ann.search_index(queries, path, probed=1.0, rescored=3000)) == state(search.knn(queries, entries))
    assert ann.search_index(queries.limit(0), path).count() == 0


def test_upserts(spark, tmp_path):
    entries, queries = data(spark, 600)
    path, staging = str(tmp_path / "index"), str(tmp_path / "staging")
    ann.write_index(entries.where("id <> 'e5' and id <> 'e6'"), path, cells=12)
    moved = [("e5", entries.where("id = 'e5'").first()["embedding"]), ("e6", entries.where("id = 'e6'").first()["embedding"]), ("e7", [float(x) for x in range(18)])]
    incoming = spark.createDataFrame(moved, entries.schema)
    touched = ann.upsert_index(incoming, path, staging)
    assert 0 < len(touched) <= 4
    whole = entries.where("id not in ('e5', 'e6', 'e7')").unionByName(incoming)
    assert state(ann.search_index(queries, path, probed=1.0, rescored=600)) == state(search.knn(queries, whole))
    assert ann.upsert_index(incoming.limit(0), path, str(tmp_path / "s2")) == []
    # all entries of the index go elsewhere: cells that are left by all are emptied
    same = spark.createDataFrame([(f"e{i}", [1.0] + [0.0] * 17) for i in range(600)], entries.schema)
    ann.upsert_index(same, path, str(tmp_path / "s3"))
    assert spark.read.parquet(f"{path}/codes").select("cell").distinct().count() == 1 and spark.read.parquet(f"{path}/vectors").count() == 600


def test_no_entries(spark):
    entries, queries = data(spark, 80)
    assert ann.knn_quantised(queries, entries.limit(0)).count() == 0
    few = entries.where("id in ('e1', 'e2')")
    assert state(ann.knn_quantised(queries, few, probed=1.0)) == state(search.knn(queries, few))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_tables(spark, sf):
    c = Corpus(spark, SF.replace("sf0.001", sf))
    exact = pairs(search.knn(c.queries, c.collection))
    assert len(exact & pairs(ann.knn_quantised(c.queries, c.collection))) >= 0.95 * len(exact)
