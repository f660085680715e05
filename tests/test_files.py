"""Files in and out, the index job and the stream."""

import json

from pyspark.sql import functions as F

from quire.functions.chunkers import ChunkConfig
from quire.jobs.index import build_index, chunk_path, embed_path
from quire.operators import search
from quire.operators.chunking import chunk_documents
from quire.sources import files
from quire.streaming.ingest import ingest_stream, latest_entries


def test_markdown_and_pages(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# a\r\n\r\nx\r".encode())
    assert files.read_markdown(spark, str(tmp_path / "a.md")).first().asDict() == {"source_file": "a.md", "markdown": "# a\n\nx\n"}
    for k in (1, 2, 10):
        (tmp_path / f"page_{k}_raw.txt").write_text(f"p{k}")
    (tmp_path / "other.txt").write_text("no")
    assert [(r["page_number"], r["raw"]) for r in files.read_raw_pages(spark, str(tmp_path)).orderBy("page_number").collect()] == [(1, "p1"), (2, "p2"), (10, "p10")]


def test_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "chunk_0001.json").write_text(json.dumps({"chunk_id": 1, "content": "a", "metadata": {"page": 3}, "length": 1}, indent=1))
    (tmp_path / "in" / "chunk_0002.json").write_text(json.dumps({"chunk_id": 2}))
    got = files.read_chunk_json(spark, str(tmp_path / "in")).orderBy("chunk_id").collect()
    assert [(r["content"], r["metadata"]) for r in got] == [("a", {"page": "3"}), ("", None)]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"id": "a", "similarity": 0.5}, {"id": "b"}]}))
    assert [(r["rank"], r["id"], r["similarity"]) for r in files.read_results(spark, str(tmp_path / "r.json")).collect()] == [(1, "a", 0.5), (2, "b", None)]
    assert embed_path(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 2


def test_chunks_written(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a\n\n## Página 1\n\nhello\n\n## b\n\nworld")
    chunks = chunk_path(spark, str(tmp_path / "a.md"), str(tmp_path / "out"))
    assert chunks.count() == 4 or chunks.count() == 3
    files.write_chunk_json(chunks, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == chunks.count()
    many = spark.range(300).select((F.col("id") % 30).alias("document_id"), F.format_string("chunk_%04d", "id").alias("chunk_id"), F.concat(F.lit("t"), "id").alias("value"))
    files.write_chunk_json(many, str(tmp_path / "many"), buckets=4, files=2)
    back = spark.read.json(str(tmp_path / "many"))
    assert sorted(map(tuple, back.select(*many.columns).collect())) == sorted(map(tuple, many.collect())) and back.select("bucket").distinct().count() <= 4
    files.write_chunk_text(many, str(tmp_path / "text"), buckets=4)
    back = spark.read.text(str(tmp_path / "text"))
    assert sorted(map(tuple, back.select("document_id", "value").collect())) == sorted(map(tuple, many.select("document_id", "value").collect()))


def test_partitions_do_not_matter(spark):
    docs = spark.range(40).select(F.col("id").alias("document_id"), F.lit("f").alias("source_file"), F.concat(F.repeat(F.lit("word "), (F.col("id") * 20).cast("int")), F.lit("\n\nend")).alias("markdown"))
    state = lambda df: sorted(map(tuple, chunk_documents(df, ChunkConfig(strategy="fixed")).collect()), key=str)
    assert state(docs.repartition(1)) == state(docs.repartition(8))


def test_index(spark):
    pages = spark.createDataFrame([(1, 1, "<x_0.1><y_0.1>Hello<x_0.2><y_0.2><class_Text>")], "document_id long, page_number int, raw string")
    got = build_index(pages, spark.createDataFrame([(1, "t")], "document_id long, title string")).collect()
    assert [(r["id"], r["title"], r["page"]) for r in got] == [("doc_1_chunk_0", "t", None), ("doc_1_chunk_1", "t", 1)]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for turn, name in enumerate(("a.md", "b.md")):
        (source / name).write_text(f"# {name}\n\ntext {turn}")
        ingest_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert latest_entries(spark, str(tmp_path / "out")).count() == 2


def test_ann_index(spark, tmp_path):
    """A written index gives the rows of the search that fits its cells anew, and reads the cells near the queries."""
    entries = spark.range(400).select(F.concat(F.lit("e"), "id").alias("id"), F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("embedding"))
    queries = entries.limit(9).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    search.write_ann_index(entries, str(tmp_path / "index"), cells=8, files=2)
    state = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "distance").collect()))
    assert state(search.knn_index(queries, str(tmp_path / "index"), k=3, probes=3)) == state(search.knn_ann(queries, entries, k=3, cells=8, probes=3))
    assert state(search.knn_index(queries, str(tmp_path / "index"), k=3, probes=8)) == state(search.knn(queries, entries, 3))
    search.write_ann_index(entries.limit(40), str(tmp_path / "index"), cells=2)
    assert spark.read.parquet(str(tmp_path / "index" / "entries")).count() == 40
    assert search.knn_index(queries.limit(0), str(tmp_path / "index")).count() == 0


def test_collection_written_back(spark, tmp_path):
    """A collection is loaded, changed and written back in one job; other collections stay; logs are appended."""
    path, staging = str(tmp_path / "collection"), str(tmp_path / "staging")
    first = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")], "collection string, id string, document string")
    files.write_collection(first, path)
    loaded = spark.read.schema(first.schema).parquet(path).where("collection = 'a'")
    files.rewrite_collection(loaded.withColumn("document", F.concat("document", F.lit("!"))), path, staging)
    spark.catalog.refreshByPath(path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select(*first.columns).collect()) == [("a", "1", "x!"), ("a", "2", "y!"), ("b", "1", "z")]
    log = spark.createDataFrame([(1, 1, "parsing", "info", "m")], "document_id long, log_id long, stage string, level string, message string")
    for _ in range(2):
        files.append_logs(log, str(tmp_path / "logs"))
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 2
