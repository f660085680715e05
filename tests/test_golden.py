"""Hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions.chunkers import ChunkConfig, fixed, hybrid, is_table, pack, sections, semantic
from quire.functions.filters import where
from quire.functions.text import occurrences, slug
from quire.operators import catalog, chunking, collection, context, conversations, layout, rerank, search, timing, vectors

PAGE = """<x_0.1><y_0.50>Body text<x_0.9><y_0.60><class_Text>
<x_0.1><y_0.05>Intro<x_0.9><y_0.10><class_Section-header>
<x_0.2><y_0.15>ignored<x_0.8><y_0.40><class_Picture>
<x_0.2><y_0.41>Figure 1-1. Rotor<x_0.8><y_0.45><class_Caption>
<x_0.1><y_0.95>12<x_0.2><y_0.98><class_Page-footer>
"""
MARKDOWN = "# d\n\n\n\n## Página 3\n\n## Intro\n\n![Figure 1-1. Rotor](figures/d_p3_fig1.png)\n\nBody text\n\n"


def elements(spark, classes):
    rows = [(1, 1, k, 0.1, k / 10, 0.5, k / 10 + 0.05, c, f"t{k}") for k, c in enumerate(classes)]
    return spark.createDataFrame(rows, "document_id long, page_number int, ord int, x1 double, y1 double, x2 double, y2 double, class string, content string")


def test_layout_page(spark):
    e = layout.layout_elements(spark.createDataFrame([(7, 3, PAGE)], "document_id long, page_number int, raw string"))
    ordered = layout.reading_order(e).orderBy("pos")
    assert [r["class"] for r in ordered.collect()] == ["Section-header", "Picture", "Caption", "Text", "Page-footer"]
    assert layout.figure_names(ordered, F.lit("d")).first()["figure_name"] == "d_p3_fig1.png"
    box = layout.crop_boxes(e, F.lit(1000), F.lit(1000)).first()
    assert (box["left"], box["top"], box["right"], box["bottom"]) == (185, 150, 815, 400)
    assert layout.nearest_caption(e).first()["caption"] == "Figure 1-1. Rotor"
    assert layout.pages_to_markdown(e).first()["markdown"] == MARKDOWN.replace("# d\n", "# doc_7\n").replace("d_p3", "7_p3")


@pytest.mark.parametrize(
    ("classes", "want"),
    [
        (["Figure", "Caption"], "![t1](figures/1_p1_fig1.png)\n\n"),
        (["Caption"], "t0\n\n"),
        (["Figure", "Figure", "Caption"], "![t2](figures/1_p1_fig2.png)\n\n"),
        (["Figure", "Text"], "t1\n\n![Figura](figures/1_p1_fig1.png)\n\n"),
        (["Figure", "Text", "Caption"], "t1\n\n![t2](figures/1_p1_fig1.png)\n\n"),
        (["Figure", "Caption", "Caption"], "![t1](figures/1_p1_fig1.png)\n\nt2\n\n"),
    ],
)
def test_captions(spark, classes, want):
    assert layout.pages_to_markdown(elements(spark, classes)).first()["markdown"] == f"# doc_1\n\n\n\n## Página 1\n\n{want}"


def test_hybrid_and_semantic():
    got = [(p.page, p.title, p.content, p.strategy) for p in hybrid(MARKDOWN, ChunkConfig())]
    assert got == [(None, None, "# d\n\n\n\n\n", "hybrid_semantic"), (3, "Intro", "## Intro\n\n![Figure 1-1. Rotor](figures/d_p3_fig1.png)\n\nBody text\n\n\n", "hybrid_semantic")]
    assert [p.page for p in semantic(MARKDOWN, ChunkConfig())] == [None, 3]
    assert [(p.page, p.content[:8]) for p in semantic(MARKDOWN, ChunkConfig(legacy_page=True))] == [(None, "# d\n\n\n\n"), (2, "## Intro")]


@pytest.mark.parametrize(
    ("text", "cfg", "want"),
    [
        ("a" * 250, ChunkConfig(100, 20, 10), [(0, 100, 100), (80, 180, 100), (160, 260, 90), (240, 340, 10)]),
        ("a" * 230 + "\n\n" + "b" * 250 + "\n" + "c" * 200, ChunkConfig(200, 50, 10), [(0, 232, 230), (182, 382, 200), (332, 483, 150), (433, 633, 200), (583, 783, 100)]),
        ("", ChunkConfig(), []),
    ],
)
def test_fixed(text, cfg, want):
    assert [(p.start, p.end, len(p.content)) for p in fixed(text, cfg)] == want


def test_fixed_covers_the_text():
    text = "".join(f"line {k}\n" * (k % 5) + "\n" for k in range(300))
    spans = [(p.start, p.end) for p in fixed(text, ChunkConfig(120, 40, 0))]
    assert spans[0][0] == 0 and spans[-1][1] >= len(text) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))


def test_packing():
    assert pack("aaaaaa\n\nbbbbbb\n\ncc", 10, 4) == ["aaaaaa", "aa\n\nbbbbbb", "bb\n\ncc"]
    table = "|h|k|\n|--|--|\n|1|2|"
    assert pack(f"intro text\n\n{table}\n\nend", 12, 4) == ["intro text", table, "2|\n\nend"]
    assert is_table(table) and not is_table("|--|--|") and not is_table("a\nb")
    assert sections("# a\nx\n## b\ny") == [(None, "# a\nx\n"), ("b", "## b\ny\n")]
    with pytest.raises(ValueError):
        ChunkConfig(100, 100)


def test_text(spark):
    row = spark.sql("SELECT ' Table 1-1.  Gross Properties (5 MW) ' AS a, 'the rotor and the other rotors' AS t").select(slug(F.col("a"), F.lit("x")).alias("s"), occurrences(F.col("t"), F.lit("the")).alias("n")).first()
    assert (row["s"], row["n"]) == ("Table_1-1._Gross_Properties_5_MW", 3)


def test_keyword(spark):
    q = spark.createDataFrame([(1, "the rotor")], "query_id long, text string")
    c = spark.createDataFrame([("a", "The rotor and the other rotors"), ("b", "none")], "id string, content string")
    assert [(r["id"], r["score"]) for r in search.keyword_search(q, c).collect()] == [("a", 5)]


def test_rerank_places(spark):
    r = spark.createDataFrame([(1, 1, "A", "a", 0.9), (1, 2, "B", "b", 0.8), (1, 3, "C", "c", 0.7)], "query_id long, rank int, id string, document string, similarity double")
    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    score = {"a": 0.1, "b": 0.9, "c": 0.5}
    got = rerank.rerank(r, q, lambda _, docs: [score[d] for d in docs]).orderBy("new_rank").collect()
    assert [(x["id"], x["rank_change"]) for x in got] == [("B", 1), ("C", 1), ("A", -2)]
    assert rerank.rerank(r.limit(0), q).count() == 0


def test_fusion(spark):
    r = spark.createDataFrame([(1, 1, "c1", 0.9), (1, 2, "c2", 0.8), (2, 1, "c2", 0.85), (2, 2, "c3", 0.7)], "query_id long, rank int, id string, similarity double")
    g = spark.createDataFrame([(0, 1), (0, 2)], "group_id long, query_id long")
    got = search.multi_query_fusion(r, g).orderBy("rank").collect()
    assert [(x["id"], x["similarity"], x["queries"]) for x in got] == [("c1", 0.9, [1]), ("c2", 0.85, [1, 2]), ("c3", 0.7, [2])]


def test_timing(spark):
    t = spark.createDataFrame([(1, k + 1, float(v)) for k, v in enumerate([4, 20, 31, 70])] + [(2, 1, 1.0), (2, 2, 5.0)], "document_id long, page_number int, elapsed double")
    got = {(r["document_id"], r["page_number"]): (r["limit_s"], r["breach"]) for r in timing.adaptive_timeout(t).collect()}
    assert got == {(1, 1): (180.0, False), (1, 2): (12.0, True), (2, 1): (180.0, False), (2, 2): (10.0, False)}
    assert {r["breach"] for r in timing.adaptive_timeout(t, 0.0).where("document_id = 2 and page_number = 2").collect()} == {True}


def test_child_counts(spark):
    ids = lambda n: spark.range(n).selectExpr("1L as document_id")
    d = spark.createDataFrame([(1, "x")], "document_id long, status string")
    row = catalog.document_counts(d, {"pages": ids(2), "images": ids(3), "tables": ids(0), "chunks": ids(4)}).first()
    assert (row["n_pages"], row["n_images"], row["n_tables"], row["n_chunks"]) == (2, 3, 0, 4)


def test_references(spark):
    a = spark.createDataFrame([(1, "see Table 1‑1")], "answer_id long, text string")
    b = spark.createDataFrame([(5, "table", "Table 1-1 Props"), (6, "table", "Table 11-12 X")], "asset_id long, kind string, caption string")
    assert [r["asset_id"] for r in context.reference_links(a, b).collect()] == [5]


def test_reference_by_file_name(spark):
    a = spark.createDataFrame([(1, "tabla  3-2 and TABLA_1, TABLA_12"), (2, "figure 4-4 stable 3-2"), (3, None)], "answer_id long, text string")
    rows = [(1, "table", "x", "a.png", "p/1"), (12, "table", None, "b.png", "p/12"), (7, "table", "none", "tab_3-2.png", "p/7"), (8, "image", "Fig 4-4", "c.png", "p/8")]
    b = spark.createDataFrame(rows, "asset_id long, kind string, caption string, file_name string, path string")
    assert sorted((r["answer_id"], r["asset_id"]) for r in context.reference_links(a, b).collect()) == [(1, 7), (2, 8)]
    got = {r["answer_id"]: r["text"] for r in context.answer_blocks(a, b).collect()}
    block = lambda caption, path: f"\n\n![{caption}]({path})\n\n"
    assert got == {1: f"tabla  3-2 and {block('x', 'p/1')}, {block('', 'p/12')}{block('none', 'p/7')}", 2: f"figure 4-4 stable 3-2{block('Fig 4-4', 'p/8')}", 3: None}
    assets = spark.createDataFrame([(1, "table", 4, "T"), (1, "table", 3, None), (2, "image", 5, "I")], "query_id long, kind string, asset_id long, caption string")
    listed = context.with_assets(spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "query_id long, context string"), assets)
    assert {r["query_id"]: r["context"] for r in listed.collect()} == {1: "c\n\nAvailable tables:\n- TABLA_3: \n- TABLA_4: T", 2: "d\n\nAvailable images:\n- IMAGEN_5: I", 3: "e"}


def test_top_moves(spark):
    rows = [(1, f"d{k}", k, n, k - n, s, 0.5) for k, n, s in ((1, 4, 0.1), (2, 1, 0.9), (3, 3, 0.5), (4, 2, 0.8), (5, 5, 0.0))]
    df = spark.createDataFrame(rows, "query_id long, id string, rank int, new_rank int, rank_change int, rerank_score double, original_score double")
    got = sorted(tuple(r) for r in rerank.rerank_top_moves(df, 1).collect())
    assert got == [(1, "faller", 1, "d1", 3.0), (1, "gain", 1, "d2", 0.4), (1, "riser", 1, "d4", 2.0)]


def test_presets_and_tables(spark):
    run, web = ChunkConfig.preset("run"), ChunkConfig.preset("web", 500)
    assert (run.chunk_size, run.overlap, run.min_size, run.max_size, run.kind) == (1200, 200, 300, 2500, "hybrid")
    assert (web.min_size, web.max_size, ChunkConfig.preset("site").kind) == (200, 2000, "semantic")
    texts = ["\n| a | b |\n |---|:-:| \n", "a | b\n--- | ---", "|---|", "x\ny\nz\n|--|--|", "\\begin{tabular}\nx", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["x"] for r in df.select("k", chunking.is_table(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [True, False, False, False, True, None] and [is_table(t) for t in texts[:5]] == got[:5]


def test_neighbours_in_blocks(spark, monkeypatch):
    """Queries and products in several blocks, equal distances by id: the same as one block."""
    rows = [(k, f"d{k:03}", [float(k % 7), float(k % 5), 1.0]) for k in range(200)]
    e = spark.createDataFrame(rows, "vec_id long, id string, embedding array<float>").repartition(3)
    q = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    take = lambda f: sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in f(q, e, 4).collect())
    whole = take(search.knn)
    monkeypatch.setattr(search, "QUERY_NUMBERS", 12)
    monkeypatch.setattr(search, "CELLS", 100)
    assert take(search.knn) == whole == take(search.knn_columns)
    pairs = {(r["query_id"], r["id"]) for r in search.similar_entries(q, e, 20.0).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert pairs == {(k, i) for k, _, a in rows if k % 20 == 0 for _, i, b in rows if dot(a, b) >= 20}


def test_filters(spark):
    df = spark.createDataFrame([(400,), (600,), (None,)], "length long").withColumn("extra", F.create_map(F.lit("k"), F.lit("3")))
    got = lambda spec: sorted(r["length"] or 0 for r in df.where(where(spec, df.columns)).collect())
    assert got({"length": {"$gt": 500}}) == [600] and got({"length": {"$ne": 600}}) == [400]
    assert got({"$or": [{"length": {"$gt": 500}}, {"length": 400}]}) == [400, 600] and got({"k": {"$gte": 3}}) == [0, 400, 600] and got({"none": 1}) == []


def test_captions_of_assets(spark):
    rows = spark.createDataFrame([(None, "t/Table_1-1._Props.png"), ("Tabla 3", "t/Table_1-1._Props.png"), ("Mass", "x.png")], "c string, p string")
    assert [r["a"] for r in rows.select(context.asset_caption(F.col("c"), F.col("p")).alias("a")).collect()] == ["Table 1-1. Props", "Table 1-1. Props", "Mass"]


def test_collection_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, document string")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "4", 3)], "id string, document string, position int")
    state = lambda df: sorted((r["id"], r["document"]) for r in df.collect())
    once = collection.upsert(old, new)
    assert state(once) == [("a", "1"), ("b", "3"), ("c", "4")] == state(collection.upsert(once, new))
    assert state(collection.upsert(old, new, "ignore")) == [("a", "1"), ("b", "1"), ("c", "4")]
    assert collection.get_by_ids(collection.delete_by_ids(old, old), old).count() == 0
    assert state(collection.reset(old.selectExpr("id", "document", "'x' as collection"), "x")) == []


def test_sessions(spark):
    s = spark.createDataFrame([("a",)], "session_id string")
    got = conversations.get_or_create_sessions(s, spark.createDataFrame([("a",), ("b",), ("b",)], "session_id string"))
    assert sorted(r["session_id"] for r in got.collect()) == ["a", "b"]


def test_latex_and_extended_style(spark):
    tex = r"\begin{tabular}{|c|c|}\hline \textbf{A} & \multicolumn{1}{c}{B} \\ 1 & 2 \\ \end{tabular}"
    got = spark.createDataFrame([(tex,)], "t string").select(layout.latex_table_md(F.col("t")).alias("m")).first()["m"]
    assert got == "| **A** | B |\n|---|---|\n| 1 | 2 |"
    styled = layout.render_elements(layout.reading_order(elements(spark, ["Caption", "TOC", "Page-footer"])), "extended").orderBy("pos").collect()
    assert [r["md"] for r in styled] == ["**t0**\n\n", "## t1\n\n", "_t2_\n\n"]


def test_ann_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("c", f"e{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(400, 8)))]
    e = spark.createDataFrame(rows, "collection string, id string, embedding array<float>")
    q = spark.createDataFrame([(k, rows[k][2]) for k in range(20)], "query_id long, embedding array<float>")
    exact = {(r["query_id"], r["id"]) for r in search.knn(q, e, 5).collect()}
    assert exact == {(r["query_id"], r["id"]) for r in search.knn_columns(q, e, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in search.knn_ann(q, e, 5, cells=8, probes=5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_pairs_of_many_rows(spark):
    df = spark.range(1001).selectExpr("printf('e%04d', id) AS id", "array(CAST(1 AS FLOAT), CAST(id AS FLOAT)) AS embedding")
    got = vectors.pairwise_similarity(df)
    assert got.count() == 1001 * 1000 // 2
    assert got.where("a = 'e0002' AND b = 'e0003'").first()["similarity"] == 7.0
