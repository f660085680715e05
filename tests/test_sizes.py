"""What larger tables bring: rare values, many pairs, long texts."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from quire.functions.chunkers import ChunkConfig
from quire.jobs import queries as Q
from quire.operators import ann, chunking, layout, search, vectors
from quire.sources.corpus import Corpus


def test_normalized_vectors_keep_the_sign_of_zero(spark, monkeypatch):
    """Components that round to zero from below are -0.0, as in SQL."""
    entries = spark.createDataFrame([("a", [1.0, -1e-8, 1e-8, 0.0])], "id string, embedding array<float>")
    monkeypatch.setattr(Corpus, "collection", entries)
    got = Q.queries()["normalize_vectors"](spark, "").first()["embedding"]
    assert got == [1.0, 0.0, 0.0, 0.0] and [math.copysign(1, x) for x in got] == [1, -1, 1, 1]


def test_rounded(spark):
    given = [0.4999995, -0.4999995, 2.5e-7, -0.0, 1e20, float("inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", vectors.rounded(vectors.F.col("x")).alias("r"))
    got = [r["r"] for r in df.orderBy("i").collect()]
    assert got == [0.5, -0.5, 0.0, 0.0, 1e20, float("inf"), None] and math.copysign(1, got[3]) == -1


def _vectors(spark, n=400, dims=8):
    x = np.random.default_rng(7).normal(size=(n, dims)).astype(np.float32)
    x[1::10] = x[0]  # copies, whose order the ids decide
    rows = [(f"v{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    entries = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    return entries, entries.where("substring(id, 4, 2) in ('00', '05', '11')").selectExpr("cast(substring(id, 2) as long) as query_id", "embedding")


def _pairs_by_lambda(df) -> bool:
    return "zip_with" in df._jdf.queryExecution().toString()


def _found(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


def test_cells_are_searched_by_blocks_of_products(spark, monkeypatch):
    entries, queries = _vectors(spark)
    monkeypatch.setattr(search, "TILE_ENTRIES", 90)
    monkeypatch.setattr(search, "TILE_QUERIES", 3)
    got = search.knn_ann(queries, entries, 5, cells=4, probes=4)
    assert not _pairs_by_lambda(got)
    assert _found(got) == _found(search.knn(queries, entries, 5))


def test_columns_rank_only_pairs_within_a_bound(spark, monkeypatch):
    entries, queries = _vectors(spark)
    for metric in search.METRICS:
        want = _found(search.knn(queries, entries, 5, metric))
        got = search.knn_columns(queries, entries, 5, metric)
        assert not _pairs_by_lambda(got) and _found(got) == want
        with monkeypatch.context() as m:
            for name, n in (("QUERY_NUMBERS", 10), ("TILE_QUERIES", 3), ("TILE_ENTRIES", 400)):
                m.setattr(search, name, n)
            assert _found(search.knn_columns(queries, entries, 5, metric)) == want
    few = search.knn_columns(queries, entries.limit(3), 5)
    assert _found(few) == _found(search.knn(queries, entries.limit(3), 5))


def test_chunks_leave_in_bounded_batches(spark, monkeypatch):
    """A task hands on chunks in batches of bounded size, not one for all texts of a batch; all of them come."""
    docs = spark.range(40).selectExpr("id as document_id", "'d' as source_file", "repeat('some words of a paragraph\n\n', 400) as markdown").coalesce(1)
    sizes = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: (f, df, schema))
    f, given, _ = chunking.chunk_documents(docs, ChunkConfig(chunk_size=400, overlap=80, max_size=1000))
    for batch in f(iter(given.toArrow().to_batches())):
        sizes.append(batch.num_rows)
    assert len(sizes) > 1 and max(sizes) <= chunking.BATCH_ROWS
    monkeypatch.undo()
    assert chunking.chunk_documents(docs, ChunkConfig(chunk_size=400, overlap=80, max_size=1000)).count() == sum(sizes)


def test_an_element_is_matched_twice_not_seven_times(spark):
    raw = "x<x_0.1><y_0.2>a > b\n<x_1 $1 \\ <x_0.3><y_0.4><class_Text><x_1><y_2><x_1.2.3><y_4><class_A b>"
    got = layout.layout_elements(spark.createDataFrame([(1, 1, raw)], "document_id long, page_number int, raw string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_") == 2
    rows = [tuple(r)[2:] for r in got.orderBy("ord").collect()]
    assert rows == [(0, 0.1, 0.2, 0.3, 0.4, "Text", "a > b\n<x_1 $1 \\ "), (1, 1.0, 2.0, None, 4.0, "A b", "")]


def test_vectors_leave_in_bounded_batches():
    class Rows:
        schema = T.StructType().add("text", "string")
        drop = lambda self, name: self
        mapInPandas = lambda self, f, schema: f

    f = vectors.embed(Rows(), "text", lambda texts: np.array([[len(x), 0] for x in texts]), normalize=False)
    made = list(f(iter([pd.DataFrame({"text": ["x" * (i % 7) for i in range(3000)]})])))
    assert [len(b) for b in made] == [1024, 1024, 952]
    assert [v[0] for b in made for v in b["embedding"]] == [i % 7 for i in range(3000)]


def test_keywords_are_counted_where_texts_are(spark, monkeypatch):
    """Texts are read once, no row is made for a token; queries of any number come in blocks, texts in groups."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abñ\U0001d4d0") for _ in range(rng.randint(1, n)))
    texts = [(i // 2 if i else None, " ".join(word(14) for _ in range(30))) for i in range(60)] + [(77, None), (78, ""), (79, "\0a\0")]
    asked = [(i, " ".join(word(9) for _ in range(5))) for i in range(12)] + [(3, "a\0 A\0"), (40, " "), (41, None)]
    given = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(texts, "id long, content string")
    every = [(q, i, sum(t.count(w) for w in a.lower().split())) for q, a in asked if a for i, t in texts if t]
    want = []
    for q in sorted({q for q, _, n in every if n}):
        best = sorted((-n, i is not None, i or 0) for r, i, n in every if r == q and n)[:4]
        want += [(q, k + 1, i if some else None, -n) for k, (n, some, i) in enumerate(best)]
    found = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    got = search.keyword_search(*given, 4)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert found(got) == want
    for name, n in (("BLOCK_WORDS", 20), ("KEY_CHARS", 3), ("GROUP_CHARS", 50), ("GROUP_COUNTS", 90)):
        monkeypatch.setattr(search, name, n)
    assert found(search.keyword_search(*given, 4)) == want
    assert search.keyword_search(given[0].limit(0), given[1]).count() == 0 and search.keyword_search(given[0], given[1].limit(0)).count() == 0


def test_counts_of_words_in_windows(monkeypatch):
    words = ["aba", "a", "bb", "abababababab", "ñ\U0001d4d0", "c\0"]
    texts = ["ababababababab cabab", "", "bbbbb ñ\U0001d4d0ñ", "c\0c\0 aba"]
    want = [[t.count(x) for x in sorted(words)] for t in texts]
    for numbers in (search.TRIE_NUMBERS, 0):
        monkeypatch.setattr(search, "TRIE_NUMBERS", numbers)
        for depth in (2, 5, 32):
            for chars in (1, 7, 1000):
                w = search._words([{"query_id": 1, "words": words}], depth)
                assert search._counts(texts, w, chars).tolist() == want


def test_entries_of_a_search_are_made_once(spark, monkeypatch):
    """Texts of the few entries that are found are held by the search; chunks and vectors aren't made again for them."""
    entries, queries = _vectors(spark)
    entries = entries.selectExpr("id", "embedding", "if(id like '%3', null, concat('text of ', id)) as document", "map('k', id) as extra")
    rows = lambda: sorted((r["query_id"], r["rank"], r["id"], r["distance"], r["similarity"], r["document"], str(r["extra"])) for r in search.knn(queries, entries, 5, keep=("document", "extra")).collect())
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapIn")
    held = rows()
    docs = spark.createDataFrame([(i, f"word{i} some words of a text", "en", "s", 30) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    asked = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(Corpus, "table", lambda self, name: {"documents": docs, "benchmark": asked}[name])
        assert made(Q.flagship(spark, "")) == 3  # chunks, vectors, search
    monkeypatch.setattr(search, "CARRIED", 0)
    assert len(held) == 5 * queries.count() and rows() == held
    assert search.knn(queries, entries.limit(0), keep=("document",)).count() == 0


def test_a_query_goes_to_bundles_not_to_cells(spark, monkeypatch):
    """However many cells a query looks into, it is one row for each bundle of them; candidates are the same."""
    entries, queries = _vectors(spark)
    model = ann.learn(entries, cells=20)
    codes = ann.encoded(entries, model).select("cell", "id", "code")
    sizes = {r["cell"]: r["count"] for r in codes.groupBy("cell").count().collect()}
    bundles = np.arange(20) // 10
    assert ann._probes(queries, model, 14, bundles).count() <= 2 * queries.count()
    found = lambda: sorted(map(tuple, ann._candidates(queries, codes, sizes, model, 14, 7).collect()))
    one = found()
    for name, n in (("BUNDLE_CODES", 50), ("TILE_CODES", 20), ("BLOCK_QUERIES", 4)):
        monkeypatch.setattr(ann, name, n)
        assert found() == one


def test_a_search_holds_no_more_for_more_entries():
    """What a task holds is bounded, however many entries come by and however many of them are equally near."""
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(2000, 16)), rng.normal(size=(10_000, 16))
    x[1::2] = x[0]

    def peak(batches: int) -> float:
        best = search._Best(np.arange(len(q)), q, 10, "cosine", None)
        tracemalloc.start()
        for i in range(batches):
            vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 16, pa.int32()), pa.array(x.ravel()))
            ids = pa.array([f"{i}_{j}" for j in range(len(x))])
            assert not list(best.put(pa.RecordBatch.from_arrays([pa.array([""] * len(x)), ids, vecs], ["part", "id", "embedding"])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert sum(b.num_rows for b in best.done()) == 10 * len(q)
        return most

    one, six = peak(1), peak(6)
    assert six < 1.2 * one and six < 120
