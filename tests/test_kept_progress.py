"""Kept vectors and scores, running thresholds over ranges of pages, progress as a stream, pairs over a threshold."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import catalog, timing, vectors
from quire.sources import kept
from quire.streaming import progress

state = lambda df: sorted((tuple(r) for r in df.collect()), key=str)


def calls(folder):
    return [line for f in folder.iterdir() for line in f.read_text().split("\n") if line]


def test_vectors_are_kept_by_text(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def fn(texts):
        import os
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write("".join(f"{t}\n" for t in texts if t))
        return vectors.hash_embed(texts)

    store = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "document_id long, content string").repartition(3)
    got = kept.embed_stored(first, "content", store, "hash", fn)
    assert state(got) == state(vectors.embed(first, "content")) and sorted(calls(folder)) == ["a b", "c"]
    more = first.unionByName(spark.createDataFrame([(6, "new words"), (7, "c")], first.schema))
    again = kept.embed_stored(more, "content", store, "hash", fn)
    assert state(again) == state(vectors.embed(more, "content")) and sorted(calls(folder)) == ["a b", "c", "new words"]
    kept.embed_stored(more.where("content = 'c'"), "content", store, "other model", fn).count()
    assert sorted(calls(folder)) == ["a b", "c", "c", "new words"]
    assert kept.embed_stored(more.limit(0), "content", store, "hash", fn).count() == 0


def test_scores_are_kept_by_pair(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def fn(queries, documents):
        import uuid

        (folder / uuid.uuid4().hex).write_text("".join(f"{q}|{d}\n" for q, d in zip(queries, documents)))
        return np.array([len(q) + len(d) / 10 for q, d in zip(queries, documents)])

    store = str(tmp_path / "store")
    pairs = spark.createDataFrame([(1, "q", "doc"), (2, "q", "doc"), (3, "qd", "oc"), (4, "q", None)], "query_id long, text string, document string")
    got = kept.score_stored(pairs, store, "m", fn)
    assert [(r["query_id"], r["rerank_score"]) for r in got.orderBy("query_id").collect()] == [(1, 1.3), (2, 1.3), (3, 2.2), (4, 1.0)]
    assert sorted(calls(folder)) == ["qd|oc", "q|", "q|doc"] or sorted(calls(folder)) == sorted(["q|", "q|doc", "qd|oc"])
    more = pairs.unionByName(spark.createDataFrame([(5, "q", "other")], pairs.schema))
    assert kept.score_stored(more, store, "m", fn).count() == 5 and len(calls(folder)) == 4


def plain_timing(pages):
    order = Window.partitionBy("document_id").orderBy("page_number")
    before = F.max("elapsed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pages.withColumn("limit_s", F.when(before.isNull(), 180.0).otherwise(F.greatest(F.lit(10.0), before * 3.0))).withColumn("breach", F.col("elapsed") > F.col("limit_s"))
    broken = F.max(F.col("breach").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("broken", F.coalesce(broken, F.lit(0))).where("broken = 0").drop("broken")


@pytest.mark.parametrize("size", [3, 10, 4096])
def test_running_thresholds_over_ranges(spark, size):
    rng = random.Random(size)
    rows = [(d, p, rng.choice([1.0, 4.0, 9.0, None, rng.random() * (60 if d % 4 == 0 else 12)])) for d in range(25) for p in range(1, rng.randint(2, 80)) if rng.random() < 0.9]
    pages = spark.createDataFrame(rows, "document_id long, page_number int, elapsed double")
    assert state(timing.adaptive_timeout(pages, size=size)) == state(plain_timing(pages))
    want = {}
    for d, p, e in sorted(rows):
        want.setdefault(d, []).append((p, e))
    got = {(r["document_id"], r["page_number"]): r for r in timing.page_time_stats(pages, size=size).collect()}
    for d, seen in want.items():
        for i in range(1, len(seen) + 1):
            known = [e for _, e in seen[:i] if e is not None]
            r = got.pop((d, seen[i - 1][0]), None)
            assert (r is not None) == (i % 10 == 0 or i == len(seen))
            if r is not None:
                assert (r["idx"], r["n_pages"], r["progress"]) == (i, len(seen), i * 100 // len(seen))
                assert (r["min_s"], r["max_s"]) == ((min(known), max(known)) if known else (None, None))
                assert (r["total_s"] is None) == (not known) and (not known or (abs(r["total_s"] - sum(known)) < 1e-9 and abs(r["avg_s"] - sum(known) / len(known)) < 1e-9))
    assert not got


def test_one_long_document_is_spread(spark):
    pages = spark.range(1, 1_000_001).select(F.lit(1).cast("long").alias("document_id"), F.col("id").cast("int").alias("page_number"), (F.lit(5.0) + F.col("id") % 7).alias("elapsed"))
    ranged = timing._ranged(pages, timing.RANGE)
    assert ranged.groupBy("page_range").count().agg(F.max("count")).first()[0] <= timing.RANGE
    got = timing.page_time_stats(pages).where("page_number in (10, 999990, 1000000)").orderBy("page_number").collect()
    assert [(r["idx"], r["progress"], r["min_s"], r["max_s"]) for r in got] == [(10, 0, 5.0, 11.0), (999990, 99, 5.0, 11.0), (1000000, 100, 5.0, 11.0)]
    assert timing.adaptive_timeout(pages).count() == 1_000_000


LOGS = "document_id long, log_id long, stage string, level string, message string, created_at timestamp"


def test_progress_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(7)
    stages, levels = list(progress.PER_CENT), ["info", "warning", "error", "success"]
    rows = [(rng.randint(1, 12), k, rng.choice(stages), rng.choice(levels), f"m{k}", 1_700_000_000 + rng.randint(0, 5000)) for k in range(300)]
    logs = spark.createDataFrame(rows, LOGS.replace("created_at timestamp", "at long")).select("document_id", "log_id", "stage", "level", "message", F.timestamp_seconds("at").alias("created_at"))
    source = str(tmp_path / "in")
    for turn in range(3):  # each run goes on from the checkpoint of the one before
        logs.where(f"log_id % 3 = {turn}").coalesce(1).write.mode("append").parquet(source)
        progress.progress_stream(spark.readStream.schema(LOGS).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"), late="10 days").awaitTermination()
        so_far = logs.where(f"log_id % 3 <= {turn}")
        assert state(progress.latest_progress(spark, str(tmp_path / "out"))) == state(progress.pipeline_progress(so_far))
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() >= 3


def test_ended_states_are_dropped(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda s: f"timestamp_seconds({1_700_000_000 + s})"
    put = lambda d, k, level, s: spark.sql(f"SELECT {d}L AS document_id, {k}L AS log_id, 'indexing' AS stage, '{level}' AS level, 'm{k}' AS message, {at(s)} AS created_at").write.mode("append").parquet(source)
    run = lambda: progress.progress_stream(spark.readStream.schema(LOGS).parquet(source), out, check, late="1 second", idle_s=60).awaitTermination()
    put(1, 1, "error", 0)
    run()
    put(1, 2, "success", 10)
    run()
    for k in range(3):  # another document moves time on
        put(2, 10 + k, "info", 1000 + 100 * k)
        run()
    put(1, 3, "info", 2000)  # a new run of a document whose state is gone: its old error is forgotten
    run()
    got = {r["document_id"]: (r["level"], r["first_error"]) for r in progress.latest_progress(spark, out).collect()}
    assert got == {1: ("info", None), 2: ("info", None)}


def test_stage_totals(spark):
    docs = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "document_id long, title string, total_pages int")
    pages, chunks = spark.createDataFrame([(1,), (1,), (3,)], "document_id long"), spark.createDataFrame([(2,)], "document_id long")
    assert state(catalog.stage_totals(docs, {"pages": pages, "chunks": chunks}).select("document_id", "title", "total_pages", "total_chunks")) == [(1, "a", 2, 0), (2, "b", 0, 1)]


@pytest.mark.parametrize("least", [0.95, 0.3, -0.2])
def test_pairs_over_a_threshold(spark, least):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 12))
    x = np.concatenate([centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, 12)) * 0.3, np.tile(centers[:1], (40, 1)), np.zeros((2, 12))])
    x = np.round(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) * rng.choice([1, 1, 1.5], (len(x), 1)), 3).astype(np.float32)
    df = spark.createDataFrame([(f"e{k:03d}", v) for k, v in enumerate(x.tolist())] + [("n", None)], "id string, embedding array<float>").repartition(4)
    s = np.round(x.astype(float) @ x.astype(float).T, 6)
    want = sorted((f"e{i:03d}", f"e{j:03d}") for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least)
    got = vectors.similar_pairs(df, least, tile=25)
    rows = [(r["a"], r["b"]) for r in got.collect()]
    assert sorted(rows) == want
    assert vectors.similar_pairs(df.limit(0), least).count() == 0
