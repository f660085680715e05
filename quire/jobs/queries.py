"""One query for each operator, over whole tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.chunkers import ChunkConfig
from quire.functions.text import slug
from quire.operators import ann, catalog, chunking, collection, context, conversations, layout, rerank, search, timing, vectors
from quire.sources.corpus import Corpus, with_sql
from quire.sources.kept import shared_folder
from quire.streaming import progress

QUERIES: dict[str, tuple[Callable[[Corpus], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = f, sql
        return f

    return add


# ---------------------------------------------------------------------------------------------------------- layout

_E = "document_id, page_number, ord"
query("layout_elements", f"SELECT {_E}, x1, y1, x2, y2, class, content FROM elements")(lambda c: layout.layout_elements(c.pages))
query("layout_page_check", "SELECT document_id, page_number, raw AS fixed, false AS truncated, CAST(len(string_split_regex(trim(raw, ' ' || chr(10) || chr(9) || chr(13)), '\\s+')) AS INTEGER) AS n_words, CAST(length(raw) AS INTEGER) AS n_chars FROM raw_pages")(lambda c: layout.layout_page_check(c.pages))


def _elements(c: Corpus) -> DataFrame:
    return layout.layout_elements(c.pages)


def _ordered(c: Corpus) -> DataFrame:
    return layout.reading_order(_elements(c))


query("reading_order", f"SELECT {_E}, pos FROM ordered")(lambda c: _ordered(c).select("document_id", "page_number", "ord", "pos"))
query("figure_names", f"SELECT {_E}, pos, figure_name FROM figs")(lambda c: layout.figure_names(_ordered(c)))
query("render_elements", "SELECT document_id, page_number, pos, class, md FROM rendered")(lambda c: layout.render_elements(_ordered(c)))
query("figure_captions", "SELECT document_id, page_number, late, pos, md FROM fig_caps WHERE md IS NOT NULL")(lambda c: layout.figure_captions(_ordered(c)))
query(
    "pages_to_markdown",
    """SELECT document_id, '# doc_' || document_id || chr(10) || chr(10) || string_agg(chr(10) || chr(10) || '## Página ' || page_number || chr(10) || chr(10) || body, '' ORDER BY page_number) AS markdown FROM (
      SELECT p.document_id, p.page_number, coalesce(string_agg(md, '' ORDER BY late, pos), '') AS body FROM (SELECT DISTINCT document_id, page_number FROM elements) p LEFT JOIN (
        SELECT document_id, page_number, 0 AS late, pos, md FROM rendered WHERE class <> 'Caption' UNION ALL SELECT document_id, page_number, late, pos, md FROM fig_caps WHERE md IS NOT NULL) USING (document_id, page_number)
      GROUP BY ALL) GROUP BY document_id""",
)(lambda c: layout.pages_to_markdown(_elements(c)))
query(
    "crop_boxes",
    f"""SELECT {_E}, class, CAST(greatest(0, floor(least(x1, x2) * 1000) - pad) AS INTEGER) AS "left", CAST(greatest(0, floor(least(y1, y2) * 1400)) AS INTEGER) AS top, CAST(least(1000, floor(greatest(x1, x2) * 1000) + pad) AS INTEGER) AS "right",
    CAST(least(1400, floor(greatest(y1, y2) * 1400)) AS INTEGER) AS bottom FROM (SELECT *, CASE class WHEN 'Table' THEN 25 WHEN 'Formula' THEN 30 ELSE 15 END AS pad FROM elements WHERE class IN ('Table', 'Figure', 'Picture', 'Formula'))""",
)(lambda c: layout.crop_boxes(_elements(c), F.lit(1000), F.lit(1400)))
query("nearest_caption", f"SELECT {_E}, class, caption FROM near_caps")(lambda c: layout.nearest_caption(_elements(c)))
query(
    "asset_names",
    f"""SELECT {_E}, class, k, CASE WHEN t AND count(*) OVER (PARTITION BY document_id, base) > 1 THEN base || '_p' || page_number || '_' || k ELSE base END AS asset_name FROM (
      SELECT *, CASE WHEN t THEN CASE WHEN s = '' THEN 'table_' || k ELSE s END ELSE document_id || '_p' || page_number || '_fig' || k END AS base FROM (
        SELECT *, class = 'Table' AS t, CAST(row_number() OVER (PARTITION BY document_id, page_number, class = 'Table' ORDER BY ord) AS INTEGER) AS k, regexp_replace(regexp_replace(caption, '\\s+', '_', 'g'), '[^A-Za-z0-9._-]', '', 'g') AS s FROM near_caps))""",
)(lambda c: layout.asset_names(_elements(c)))
query("page_asset_counts", "SELECT document_id, page_number, count(*) FILTER (WHERE class IN ('Picture', 'Figure')) AS n_figures, count(*) FILTER (WHERE class = 'Table') AS n_tables, count(*) FILTER (WHERE class IN ('Table', 'Figure', 'Picture', 'Formula')) AS n_boxes FROM elements GROUP BY ALL")(
    lambda c: layout.page_asset_counts(_elements(c))
)


@query(
    "asset_page_link",
    """SELECT f.document_id, f.figure_name AS name, CAST(row_number() OVER (PARTITION BY f.document_id ORDER BY f.figure_name) - 1 AS INTEGER) AS position, f.page_number AS linked_page, 'extracted_images/' || f.document_id || '/' || f.figure_name AS path FROM figs f""",
)
def asset_page_link(c: Corpus) -> DataFrame:
    return layout.asset_page_link(layout.figure_names(_ordered(c)).select("document_id", F.col("figure_name").alias("name")), c.pages)


query("slugify", "SELECT doc_id, CASE WHEN s = '' THEN 'doc_' || doc_id ELSE s END AS slug FROM (SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g'), '[^A-Za-z0-9._-]', '', 'g'), 80) AS s FROM documents)")(
    lambda c: c.table("documents").select("doc_id", slug(F.col("text"), F.concat(F.lit("doc_"), "doc_id"), 80).alias("slug"))
)

# ---------------------------------------------------------------------------------------------------------- timing

query(
    "adaptive_timeout",
    """SELECT document_id, page_number, elapsed, limit_s, elapsed > limit_s AS breach FROM (SELECT *, max(CAST(elapsed > limit_s AS INTEGER)) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM (
      SELECT *, CASE WHEN before IS NULL THEN 180.0 ELSE greatest(10.0, 3.0 * before) END AS limit_s FROM (SELECT *, max(elapsed) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM timings))) WHERE coalesce(broken, 0) = 0""",
)(lambda c: timing.adaptive_timeout(c.timings))


@query(
    "page_time_stats",
    """SELECT document_id, page_number, idx, n_pages, floor(a * 1e6 + 0.501) / 1e6 AS avg_s, mn AS min_s, mx AS max_s, floor(t * 1e6 + 0.501) / 1e6 AS total_s, CAST(floor(idx * 100 / n_pages) AS INTEGER) AS progress FROM (SELECT *, CAST(row_number() OVER w AS INTEGER) AS idx, count(*) OVER (PARTITION BY document_id) AS n_pages,
      avg(elapsed) OVER w AS a, min(elapsed) OVER w AS mn, max(elapsed) OVER w AS mx, sum(elapsed) OVER w AS t FROM timings WINDOW w AS (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE idx % 10 = 0 OR idx = n_pages""",
)
def page_time_stats(c: Corpus) -> DataFrame:
    return timing.page_time_stats(c.timings).withColumns({n: F.floor(F.col(n) * 1e6 + 0.501) / 1e6 for n in ("avg_s", "total_s")})


# -------------------------------------------------------------------------------------------------------- chunking

HYBRID = ChunkConfig(chunk_size=400, overlap=80, max_size=1000)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\pZ\\x0b\\x1c-\\x1f\\x{{85}}]+|[\\s\\pZ\\x0b\\x1c-\\x1f\\x{{85}}]+$', '', 'g')"


_BLANK = "chr(10) || chr(10)"


def _parts_sql(mark: str) -> str:
    """Sections of the pages that a mark parts: (document_id, source_file, part, page, section, title, body)."""
    return f"""SELECT document_id, source_file, part, page, CAST(section AS INTEGER) AS section, max(h) FILTER (WHERE h <> '') AS title, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS body FROM (
      SELECT *, sum(CAST(h <> '' AS INTEGER)) OVER (PARTITION BY document_id, part ORDER BY pos) AS section FROM (
        SELECT *, regexp_extract(line, '^#{{2,}}\\s+(.+)$', 1) AS h FROM (
          SELECT document_id, source_file, part, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (
            SELECT document_id, source_file, unnest(string_split_regex(markdown, '{mark}')) AS text, generate_subscripts(string_split_regex(markdown, '{mark}'), 1) - 1 AS part,
              unnest(list_prepend(NULL, list_transform(regexp_extract_all(markdown, '{mark}', 1), lambda x: CAST(x AS INTEGER)))) AS page FROM markdown))))
      GROUP BY ALL HAVING {_strip("body")} <> ''"""


def _packed_sql(parts: str, size: int = 400, overlap: int = 80) -> str:
    """The bodies of parts as pieces (document_id, part, section, piece, content), a paragraph for each step."""
    rule = f"len(string_split(p, chr(10))) >= 2 AND (len(list_filter(string_split(p, chr(10))[1:3], lambda x: regexp_matches(x, '^\\s*\\|[\\s:|-]+\\|\\s*$'))) > 0 OR contains(p, '\\begin{{tabular}}') OR contains(p, '\\end{{tabular}}'))"
    return f"""SELECT document_id, part, section, CAST(row_number() OVER (PARTITION BY document_id, part, section ORDER BY i) - 1 AS INTEGER) AS piece, content FROM (
      WITH RECURSIVE packing AS (
        SELECT document_id, part, section, list_filter(list_transform(string_split(body, {_BLANK}), lambda x: {_strip("x")}), lambda x: x <> '') AS ps, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS content FROM ({parts})
        UNION ALL
        SELECT document_id, part, section, ps, i + 1, CASE WHEN NOT ends THEN held WHEN {rule} OR {_strip(f"right(held, {overlap})")} = '' THEN '' ELSE {_strip(f"right(held, {overlap})")} || {_BLANK} END || p || {_BLANK}, CASE WHEN ends THEN {_strip("held")} END
        FROM (SELECT *, ps[i + 1] AS p, held <> '' AND (i = len(ps) OR length(held) + length(ps[i + 1]) > {size}) AS ends FROM packing WHERE i <= len(ps))
      ) SELECT * FROM packing WHERE content IS NOT NULL)"""


def _chunks_sql(mark: str, whole: str, split: str, largest: int = 1000) -> str:
    """Sections of pages, those over the largest size in pieces."""
    parts = _parts_sql(mark)
    return f"""SELECT document_id, chunk_index, printf('chunk_%04d', chunk_index) AS chunk_id, content, CAST(length(content) AS INTEGER) AS length, page, title AS section_title, strategy, CAST(NULL AS INTEGER) AS start_pos, CAST(NULL AS INTEGER) AS end_pos, source_file, total_chunks FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY part, section, piece) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY document_id) AS INTEGER) AS total_chunks FROM (
        SELECT document_id, source_file, part, page, section, title, 0 AS piece, body AS content, '{whole}' AS strategy FROM ({parts}) WHERE length(body) <= {largest} UNION ALL
        SELECT document_id, source_file, part, page, section, title, piece, content, '{split}' FROM ({_packed_sql(f"SELECT * FROM ({parts}) WHERE length(body) > {largest}")}) JOIN ({parts}) USING (document_id, part, section)))"""


_HYBRID_SQL = _chunks_sql("## Página (\\d+)", "hybrid_semantic", "hybrid_split")
query("chunk_hybrid", _HYBRID_SQL)(lambda c: chunking.chunk_documents(c.markdown, HYBRID))
query("chunk_semantic", _chunks_sql("\\n## Página (\\d+)\\n", "semantic", "semantic_split"))(lambda c: chunking.chunk_documents(c.markdown, ChunkConfig(chunk_size=400, overlap=80, max_size=1000, strategy="semantic")))
FIXED = ChunkConfig(strategy="fixed")


@query(
    "chunk_fixed",
    """SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, s AS start_pos, e AS end_pos, CAST(length(content) AS INTEGER) AS length, content FROM (
      SELECT *, regexp_replace(text[s + 1:e], '^\\s+|\\s+$', '', 'g') AS content FROM (
        WITH RECURSIVE cuts AS (
          SELECT doc_id AS document_id, text, CAST(length(text) AS INTEGER) AS n, CAST(0 AS INTEGER) AS s, CAST(NULL AS INTEGER) AS e FROM documents WHERE text <> ''
          UNION ALL
          SELECT document_id, text, n, CASE WHEN e IS NULL THEN s WHEN e - 200 > s THEN e - 200 ELSE e END, CASE WHEN e IS NULL THEN
            CASE WHEN s + 1000 >= n THEN s + 1000 WHEN instr(text[s + 901:s + 1100], chr(10) || chr(10)) > 0 THEN CAST(s + 900 + instr(text[s + 901:s + 1100], chr(10) || chr(10)) + 1 AS INTEGER)
              WHEN instr(text[s + 951:s + 1050], chr(10)) > 0 THEN CAST(s + 950 + instr(text[s + 951:s + 1050], chr(10)) AS INTEGER) ELSE s + 1000 END END
          FROM cuts WHERE e IS NULL AND s < n OR e IS NOT NULL
        ) SELECT * FROM cuts WHERE e IS NOT NULL)) WHERE length(content) >= 100""",
)
def chunk_fixed(c: Corpus) -> DataFrame:
    docs = c.table("documents").select(F.col("doc_id").alias("document_id"), F.lit("t").alias("source_file"), F.col("text").alias("markdown"))
    return chunking.chunk_documents(docs, FIXED).select("document_id", "chunk_index", "start_pos", "end_pos", "length", "content")


_SECTIONS = """SELECT document_id, CAST(section AS INTEGER) AS section, max(h) FILTER (WHERE h <> '') AS title, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS body FROM (SELECT *, sum(CAST(h <> '' AS INTEGER)) OVER (PARTITION BY document_id ORDER BY pos) AS section FROM (
      SELECT *, regexp_extract(line, '^#{2,}\\s+(.+)$', 1) AS h FROM (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM markdown)))
    GROUP BY document_id, section HAVING trim(string_agg(line, ''), ' ' || chr(9) || chr(13)) <> ''"""
query("sections", _SECTIONS)(lambda c: chunking.sections(c.markdown))
query("pack_paragraphs", f"SELECT document_id, section, piece, content FROM ({_packed_sql(f'SELECT 0 AS part, * FROM ({_SECTIONS})')})")(lambda c: chunking.pack_paragraphs(chunking.sections(c.markdown), 400, 80))
_TABLED = "CASE WHEN document_id % 3 = 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' WHEN document_id % 3 = 1 THEN 'a | b' || chr(10) || '--- | ---' ELSE markdown END"
query("is_table", f"""SELECT document_id, len(lines) >= 2 AND len(list_filter(lines[1:3], lambda x: regexp_matches(x, '^\\|[\\s:|-]+\\|$'))) > 0 AS is_table
    FROM (SELECT document_id, list_transform(string_split(regexp_replace({_TABLED}, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS lines FROM markdown)""")(
    lambda c: c.markdown.select("document_id", chunking.is_table(F.expr(_TABLED.replace("chr(10)", "char(10)"))).alias("is_table"))
)
query("chunk_stats", "SELECT count(*) AS n_chunks, round(avg(length), 6) AS avg_length, min(length) AS min_length, max(length) AS max_length, CAST(sum(length) AS BIGINT) AS total_length FROM chunks")(
    lambda c: chunking.chunk_stats(c.chunks).withColumn("avg_length", F.round("avg_length", 6))
)
query("strategy_dist", "SELECT strategy, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM chunks GROUP BY strategy")(lambda c: chunking.strategy_dist(c.chunks))
query("chunks_per_page", "SELECT document_id, page, count(*) AS n FROM chunks GROUP BY ALL")(lambda c: chunking.chunks_per_page(c.chunks))
query("chunk_extremes", "SELECT document_id, arg_min(chunk_index, -length * 1000000 + chunk_index) AS longest, arg_min(chunk_index, length * 1000000 + chunk_index) FILTER (WHERE length > 100) AS shortest FROM (SELECT document_id, chunk_index, CAST(length AS BIGINT) AS length FROM chunks) GROUP BY document_id")(
    lambda c: chunking.chunk_extremes(c.chunks)
)
query("chunk_filters", "SELECT count(*) FILTER (WHERE page = 1) AS on_first_page, count(*) FILTER (WHERE contains(lower(content), 'the')) AS with_word, count(*) FILTER (WHERE length > 1000) AS long, count(section_title) AS titled, count(*) FILTER (WHERE contains(content, '|') AND contains(content, '---')) AS tabular FROM chunks")(
    lambda c: chunking.chunk_filters(c.chunks, "the")
)
query("chunk_features", "SELECT document_id, chunk_index, CASE WHEN s = '' THEN 0 ELSE CAST(len(string_split_regex(s, '\\s+')) AS INTEGER) END AS n_words, contains(content, '$') AS has_formula FROM (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS s FROM chunks)")(
    lambda c: chunking.chunk_features(c.chunks)
)
query("embedding_export", "SELECT 'doc_chunk_' || chunk_index AS id, content AS text, page, section_title AS section, source_file AS source FROM chunks")(lambda c: chunking.embedding_export(c.chunks))
query("chunk_preview", "SELECT document_id, chunk_index, CASE WHEN length(content) <= 100 THEN content ELSE left(content, 100) || '...' END AS preview FROM chunks")(lambda c: chunking.chunk_preview(c.chunks))
query("chunk_text_export", "SELECT document_id, chunk_index, '<!-- Chunk ID: ' || chunk_index || ' -->' || chr(10) || '<!-- Metadata: page=' || coalesce(CAST(page AS VARCHAR), 'None') || ', strategy=' || strategy || ' -->' || chr(10) || chr(10) || content AS value FROM chunks")(
    lambda c: chunking.chunk_text_export(c.chunks)
)
query(
    "chunks_combined",
    """SELECT document_id, 'Document ' || document_id || chr(10) || 'Total chunks: ' || count(*) || chr(10) || repeat('=', 80) || chr(10) || string_agg('Chunk ' || chunk_index || chr(10) || 'Strategy: ' || strategy || chr(10) || 'Length: ' || length || chr(10) || chr(10) || content || chr(10) || chr(10) || repeat('=', 80) || chr(10), '' ORDER BY chunk_index) AS combined
    FROM chunks GROUP BY document_id""",
)(lambda c: chunking.chunks_combined(c.chunks))

# --------------------------------------------------------------------------------------------------------- vectors


def _embedded_sql(rows: str, keys: str) -> str:
    """Rows (keys, text) with the vectors of vectors.hash_embed, in single precision."""
    return f"""SELECT {keys}, list(CAST(CASE WHEN n IS NULL THEN 0 ELSE n / CAST(CAST(norm AS FLOAT) AS DOUBLE) END AS FLOAT) ORDER BY d) AS embedding FROM (SELECT {keys}, unnest(range(64)) AS d FROM ({rows})) LEFT JOIN (
      SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS norm FROM (SELECT {keys}, CAST('0x' || left(h, 4) AS INTEGER) % 64 AS d, CAST(sum(CASE WHEN h[5] >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS n FROM (
        SELECT {keys}, md5(w) AS h FROM (SELECT {keys}, unnest(string_split_regex(lower(text), '[\\s\\pZ\\x0b\\x1c-\\x1f\\x{{85}}]+')) AS w FROM ({rows})) WHERE w <> '') GROUP BY ALL HAVING n <> 0)) USING ({keys}, d) GROUP BY ALL"""


def _text_near_sql(entries: str, shown: str = "") -> str:
    """The three nearest of entries (id, text) to each benchmark text; distances of vectors without words are 1."""
    asked = _embedded_sql("SELECT query_id, text FROM questions", "query_id")
    return f"""SELECT query_id, rank, id, distance, round(1 - distance, 6) AS similarity{", text AS document" if shown else ""} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (
      SELECT query_id, id, round(1 - CASE WHEN list_dot_product(q, q) = 0 OR list_dot_product(e, e) = 0 THEN 0 ELSE list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))) END, 6) AS distance
      FROM (SELECT query_id, CAST(embedding AS DOUBLE[]) AS q FROM ({asked})), (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM ({_embedded_sql(entries, "id")})))) JOIN ({entries}) USING (id) WHERE rank <= 3"""


query("embed_chunks", _embedded_sql(f"SELECT document_id, chunk_index, content AS text FROM ({_HYBRID_SQL})", "document_id, chunk_index"))(lambda c: vectors.embed(chunking.chunk_documents(c.markdown, HYBRID), "content").select("document_id", "chunk_index", "embedding"))
_DOUBLE = "CAST(embedding AS DOUBLE[])"
query("normalize_vectors", f"SELECT id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS embedding FROM (SELECT id, {_DOUBLE} AS v FROM entries)")(
    lambda c: vectors.normalize_vectors(c.collection).select("id", F.transform("embedding", lambda x: vectors.rounded(x)).alias("embedding"))
)
query("vector_profile", f"SELECT id, CAST(len(embedding) AS INTEGER) AS dims, round(sqrt(list_dot_product({_DOUBLE}, {_DOUBLE})), 6) AS norm FROM entries")(lambda c: vectors.vector_profile(c.collection))
query("vector_preview", "SELECT id, embedding[1:5] AS preview FROM entries")(lambda c: vectors.vector_preview(c.collection))


@query("attach_embeddings", "SELECT document_id, chunk_index, CAST(len(embedding) AS INTEGER) AS embedding_dimension, length FROM chunks JOIN embeddings ON vec_id = document_id WHERE chunk_index = 0")
def attach_embeddings(c: Corpus) -> DataFrame:
    made = c.table("embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return vectors.attach_embeddings(c.chunks, made).select("document_id", "chunk_index", "embedding_dimension", "length")


query("similar_entries", "SELECT q.vec_id AS query_id, e.id, round(list_dot_product(q.v, e.v), 6) AS similarity FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM entries WHERE vec_id % 20 = 0) q JOIN (SELECT id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM entries) e ON q.vec_id <> e.vec_id WHERE round(list_dot_product(q.v, e.v), 6) >= 0.25")(
    lambda c: search.similar_entries(c.queries, c.collection, 0.25).where(F.col("id") != F.concat(F.lit("doc_"), "query_id", F.lit("_chunk_0")))
)
query("pairwise_similarity", f"SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM (SELECT id, {_DOUBLE} AS v FROM entries) a JOIN (SELECT id, {_DOUBLE} AS v FROM entries) b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.4")(
    lambda c: vectors.similar_pairs(c.collection, 0.4)
)
query("item_neighbors", "SELECT 'doc_5_chunk_0' AS item, id, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM entries WHERE vec_id = 5)), 6) AS similarity FROM entries WHERE vec_id <> 5 ORDER BY similarity DESC, id LIMIT 3")(
    lambda c: vectors.item_neighbors(c.collection, F.lit("doc_5_chunk_0"))
)
query("embedding_run_stats", "SELECT count(*) AS num_chunks, CAST(max(len(embedding)) AS INTEGER) AS embedding_dimension, 'hash' AS model, true AS normalized, 'demo' AS alias, 'columns' AS backend, 1.5 :: DOUBLE AS seconds, '2026-01-01 00:00:00' AS timestamp FROM entries")(
    lambda c: vectors.embedding_run_stats(c.collection, "hash", alias="demo", backend="columns", seconds=1.5, timestamp="2026-01-01 00:00:00")
)

# ---------------------------------------------------------------------------------------------------------- search


def _near(metric: str):
    return lambda c: search.knn(c.queries, c.collection, 5, metric).select("query_id", "rank", "id", "distance", "similarity")


def _near_sql(column: str, rest: str = "") -> str:
    return f"SELECT query_id, rank, id, {column} AS distance, round(1 - {column}, 6) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {column}, id) AS INTEGER) AS rank FROM sims {rest}) WHERE rank <= 5"


query("knn_cosine", _near_sql("distance"))(_near("cosine"))
query("knn_l2", _near_sql("l2"))(_near("l2"))
query("knn_ip", _near_sql("ip"))(_near("ip"))
query("knn_columns", _near_sql("distance"))(lambda c: search.knn_columns(c.queries, c.collection).select("query_id", "rank", "id", "distance", "similarity"))
query("knn_ann")(lambda c: ann.knn_quantised(c.queries, c.collection))
query("knn_cells")(lambda c: search.knn_ann(c.queries, c.collection))
query("search_text", _text_near_sql("SELECT id, document AS text FROM entries"))(lambda c: search.search_text(c.questions, vectors.embed(c.collection, "document"), k=3))
WHERE = {"$and": [{"length": {"$gt": 500}}, {"lang": {"$in": ["en", "de"]}}], "half": "0"}
query("knn_where", _near_sql("distance", "WHERE length > 500 AND lang IN ('en', 'de') AND vec_id % 2 = 0"))(lambda c: search.knn(c.queries, c.collection, 5, where_spec=WHERE).select("query_id", "rank", "id", "distance", "similarity"))
query("knn_where_document", _near_sql("distance", "WHERE contains(document, 'the') AND NOT contains(document, 'Th')"))(
    lambda c: search.knn(c.queries, c.collection, 5, document_spec={"$and": [{"$contains": "the"}, {"$not_contains": "Th"}]}).select("query_id", "rank", "id", "distance", "similarity")
)
query("hybrid_search", "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance, similarity FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM knn20 WHERE contains(lower(document), 'th') AND contains(lower(document), 'en')) WHERE rank <= 5")(
    lambda c: search.hybrid_search(c.queries, c.collection, ["th", "en"])
)
query(
    "keyword_search",
    """SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT q.query_id, d.doc_id AS id,
      CAST(list_sum(list_transform(list_filter(string_split_regex(lower(q.text), '\\s+'), lambda w: w <> ''), lambda w: (length(lower(d.text)) - length(replace(lower(d.text), w, ''))) // length(w))) AS INTEGER) AS score FROM questions q, documents d) WHERE score > 0) WHERE rank <= 3""",
)(lambda c: search.keyword_search(c.questions, c.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))))


def _groups(c: Corpus) -> DataFrame:
    return c.queries.select((F.col("query_id") % 3).alias("group_id"), "query_id")


query(
    "multi_query_fusion",
    """SELECT group_id, id, similarity, queries, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM (SELECT query_id % 3 AS group_id, id, max(similarity) AS similarity, list_sort(list(DISTINCT query_id)) AS queries FROM knn20 WHERE rank <= 2 GROUP BY ALL)) WHERE rank <= 5""",
)(lambda c: search.multi_query_fusion(search.knn(c.queries, c.collection, 2), _groups(c)))
query(
    "multi_collection",
    "SELECT query_id, id, distance, round(1 - distance, 6) AS similarity, collection, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, id) AS r FROM sims) WHERE r <= 3",
)(lambda c: search.multi_collection(c.queries, c.collection, ["c0", "c1", "c2"]))
SYNONYMS = [("the", "these those"), ("de", "of from"), ("en", "in")]
query("query_expansion", "SELECT query_id, CASE WHEN contains(lower(text), 'the') THEN text || ' these those' WHEN contains(lower(text), 'de') THEN text || ' of from' WHEN contains(lower(text), 'en') THEN text || ' in' ELSE text END AS expanded FROM questions")(
    lambda c: search.query_expansion(c.questions, SYNONYMS)
)

# ------------------------------------------------------------------------------------------------------ collection


@query("collection_load", "SELECT 'main' AS collection, 'doc_' || document_id || '_chunk_' || chunk_index AS id, content AS document, length, 'unknown' AS embedding_model, CAST(CASE WHEN chunk_index = 0 THEN coalesce(len(embedding), 0) ELSE 0 END AS INTEGER) AS dims FROM chunks LEFT JOIN embeddings ON vec_id = document_id")
def collection_load(c: Corpus) -> DataFrame:
    made = c.table("embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    rows = c.chunks.join(made, ["document_id", "chunk_index"], "left").withColumn("embedding_model", F.lit(None).cast("string"))
    return collection.collection_load(rows, "main").withColumn("dims", F.size("embedding")).drop("embedding")


query("clean_metadata", "SELECT id, to_json(CASE WHEN lang IS NULL THEN {'half': CAST(vec_id % 2 AS VARCHAR)} END) AS no_lang, CASE WHEN lang IS NULL THEN 1 ELSE 2 END AS n_keys FROM entries")(
    lambda c: collection.clean_metadata(c.collection).select("id", F.when(F.col("lang").isNull(), F.to_json("extra")).alias("no_lang"), F.size("extra").alias("n_keys"))
)
query(
    "collection_entries",
    "SELECT 'doc_' || document_id || '_chunk_' || chunk_index AS id, content AS document, title, 'own' AS chunk_id, CAST(chunk_index AS VARCHAR) AS chunk_index, strategy FROM chunks JOIN docs USING (document_id)",
)(
    lambda c: collection.collection_entries(c.chunks.withColumn("extra", F.create_map(F.lit("chunk_id"), F.lit("own"), F.lit("strategy"), F.col("strategy"))), c.documents).select("id", "document", *[F.col("extra")[k].alias(k) for k in ("title", "chunk_id", "chunk_index", "strategy")])
)


@query("collection_upsert", "SELECT id, CASE WHEN vec_id % 3 = 0 THEN 'v2' ELSE document END AS document FROM entries UNION ALL SELECT 'new_' || vec_id, 'v2' FROM entries WHERE vec_id % 100 = 0")
def collection_upsert(c: Corpus) -> DataFrame:
    some = c.collection.where("vec_id % 3 = 0")
    new = c.collection.where("vec_id % 100 = 0").select(F.concat(F.lit("new_"), "vec_id").alias("id"))
    rows = some.select("id", F.lit("v1").alias("document"), F.lit(1).alias("position")).unionByName(some.select("id", F.lit("v2").alias("document"), F.lit(2).alias("position"))).unionByName(new.select("id", F.lit("v2").alias("document"), F.lit(3).alias("position")))
    return collection.upsert(c.collection.select("id", "document"), rows)


def _ids(c: Corpus) -> DataFrame:
    return c.collection.where("vec_id % 7 = 0").select("id")


query("get_by_ids", "SELECT id, document, label FROM entries WHERE vec_id % 7 = 0")(lambda c: collection.get_by_ids(c.collection, _ids(c)).select("id", "document", "label"))
query("delete_by_ids", "SELECT id, label FROM entries WHERE vec_id % 7 <> 0")(lambda c: collection.delete_by_ids(c.collection, _ids(c)).select("id", "label"))
query("update_metadata", "SELECT id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE CAST(vec_id % 2 AS VARCHAR) END AS half, lang FROM entries")(
    lambda c: collection.update_metadata(c.collection, _ids(c).select("id", F.create_map(F.lit("half"), F.lit("new")).alias("changes"))).select("id", F.col("extra")["half"].alias("half"), F.col("extra")["lang"].alias("lang"))
)
query("collection_stats", "SELECT collection, count(*) AS n, 'cosine' AS metric FROM entries GROUP BY collection")(lambda c: collection.collection_stats(c.collection))
query("collection_peek", "SELECT id, document FROM entries ORDER BY id LIMIT 5")(lambda c: collection.peek(c.collection.select("id", "document")))


@query("rebuild_entries", "SELECT 'doc_' || document_id || '_chunk_' || chunk_index AS id, document_id, title, length(content) AS n FROM chunks JOIN docs USING (document_id) JOIN embeddings ON vec_id = document_id WHERE indexed")
def rebuild_entries(c: Corpus) -> DataFrame:
    rows = c.chunks.join(c.table("embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), "document_id", "left")
    return collection.rebuild_entries(rows, c.documents).select("id", "document_id", "title", F.length("content").cast("long").alias("n"))


# ---------------------------------------------------------------------------------------------------------- rerank


def _results(c: Corpus) -> DataFrame:
    near = search.knn(c.queries, c.collection, 10, keep=("document", "vec_id"))
    return near.select("query_id", "rank", "id", F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "similarity", "document")


def _asked(c: Corpus) -> DataFrame:
    return c.collection.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("document").alias("text"))


def _reranked(c: Corpus, top_k: int | None = None) -> DataFrame:
    return rerank.rerank(_results(c), _asked(c), top_k=top_k)


_R = "query_id, id, rank, new_rank, rank_change, rerank_score, original_score"
query("rerank", f"SELECT {_R} FROM reranked WHERE new_rank <= 5")(lambda c: _reranked(c, 5).select(*_R.split(", ")))
query("rerank_compare", "SELECT query_id, id, CASE WHEN rank <= 5 THEN rank END AS rank_before, CASE WHEN new_rank <= 5 THEN new_rank END AS rank_after FROM reranked WHERE rank <= 5 OR new_rank <= 5")(lambda c: rerank.rerank_compare(_reranked(c)))
query("rerank_movement", "SELECT query_id, count(*) FILTER (WHERE rank_change > 0) AS up, count(*) FILTER (WHERE rank_change < 0) AS down, count(*) FILTER (WHERE rank_change = 0) AS same, max(abs(rank_change)) AS largest FROM reranked GROUP BY query_id")(
    lambda c: rerank.rerank_movement(_reranked(c))
)
query("rerank_improvement", "SELECT query_id, sign(s) * ((2 * abs(s) + n) // (2 * n)) / 1000000 AS mean_gain, best / 1000000 AS best_gain FROM (SELECT query_id, CAST(sum(u) AS BIGINT) AS s, count(*) AS n, max(u) AS best FROM (SELECT query_id, CAST(round((rerank_score - original_score) * 1000000) AS BIGINT) AS u FROM reranked) GROUP BY query_id)")(lambda c: rerank.rerank_improvement(_reranked(c)))
query("rerank_top_moves", """SELECT query_id, kind, place, id, amount FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY amount DESC, rank) AS INTEGER) AS place FROM (
    SELECT query_id, id, rank, 'riser' AS kind, CAST(rank_change AS DOUBLE) AS amount FROM reranked UNION ALL SELECT query_id, id, rank, 'faller', CAST(-rank_change AS DOUBLE) FROM reranked
    UNION ALL SELECT query_id, id, rank, 'gain', round(rerank_score - original_score, 6) FROM reranked) WHERE amount > 0) WHERE place <= 3""")(lambda c: rerank.rerank_top_moves(_reranked(c)))
query("selective_rerank", "SELECT query_id, id, final_rank FROM (SELECT *, CASE WHEN max(similarity) OVER (PARTITION BY query_id) < 0.7 THEN new_rank ELSE rank END AS final_rank FROM reranked) WHERE final_rank <= 5")(
    lambda c: rerank.selective_rerank(_reranked(c)).select("query_id", "id", "final_rank")
)
query(
    "subquery_fusion",
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank FROM (SELECT query_id % 3 AS group_id, id, max(rerank_score) AS rerank_score FROM reranked WHERE new_rank <= 3 GROUP BY ALL)) WHERE rank <= 5",
)(lambda c: rerank.subquery_fusion(_reranked(c), _groups(c)))
query("rerank_dedup", "SELECT a.query_id, r.id, r.rerank_score, r.new_rank FROM asked a JOIN (SELECT text, min(query_id) AS f FROM asked GROUP BY text) g USING (text) JOIN reranked r ON r.query_id = g.f")(lambda c: rerank.rerank_dedup(_results(c), _asked(c)))

# --------------------------------------------------------------------------------------------------------- context


def _found(c: Corpus) -> DataFrame:
    return context.retrieve_chunks(_results(c).select("query_id", "rank", "document_id", "chunk_index"), c.chunks)


query("retrieve_chunks", "SELECT query_id, rank, document_id, chunk_index, content FROM found")(lambda c: _found(c).select("query_id", "rank", "document_id", "chunk_index", "content"))
_CONTEXT = "SELECT query_id, string_agg('Documento: ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM found JOIN docs USING (document_id) GROUP BY query_id"
query("build_context", _CONTEXT)(lambda c: context.build_context(_found(c), c.documents))
query("build_prompt", f"SELECT query_id, CASE WHEN context IS NULL THEN 'Pregunta: ' || text || chr(10) || chr(10) || 'No hay documentos.' ELSE 'Contexto:' || chr(10) || context || chr(10) || chr(10) || 'Pregunta: ' || text END AS prompt FROM asked LEFT JOIN ({_CONTEXT}) USING (query_id)")(
    lambda c: context.build_prompt(_asked(c), context.build_context(_found(c), c.documents))
)
query("context_tagged", "SELECT query_id, string_agg('[Chunk ' || rank || ', Página ' || coalesce(CAST(page AS VARCHAR), 'N/A') || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM found GROUP BY query_id")(lambda c: context.context_tagged(_found(c)))
query(
    "context_scored",
    """SELECT *, CAST(len(string_split_regex(regexp_replace(context, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS INTEGER) AS n_words, CAST(length(context) AS INTEGER) AS n_chars FROM (SELECT query_id, string_agg('--- Document ' || new_rank || ' (Score: ' || printf('%.4f', rerank_score) || ') ---' || chr(10) || document, chr(10) || chr(10) ORDER BY new_rank) AS context, count(*) AS n_documents FROM reranked GROUP BY query_id)""",
)(lambda c: context.context_scored(_reranked(c)))


def _assets(c: Corpus, *kinds: str) -> DataFrame:
    rows = _elements(c).where(F.col("class").isin(*kinds))
    return rows.select("document_id", "page_number", (F.col("document_id") * 1000000 + F.col("page_number") * 1000 + F.col("ord")).alias("asset_id"))


_ASSET = "document_id * 1000000 + page_number * 1000 + ord AS asset_id"
query("context_tables", f"SELECT f.query_id, f.document_id, t.asset_id FROM (SELECT DISTINCT query_id, document_id FROM found WHERE rank <= 3) f JOIN (SELECT document_id, {_ASSET} FROM elements WHERE class = 'Table') t USING (document_id)")(lambda c: context.context_tables(_found(c), _assets(c, "Table")))
query("context_images", f"SELECT DISTINCT f.query_id, f.document_id, i.asset_id FROM (SELECT query_id, document_id, 1 AS page FROM found WHERE rank <= 3) f JOIN (SELECT document_id, page_number, {_ASSET} FROM elements WHERE class IN ('Picture', 'Figure')) i ON i.document_id = f.document_id AND i.page_number = f.page")(
    lambda c: context.context_images(_found(c).withColumn("page", F.coalesce("page", F.lit(1))), _assets(c, "Picture", "Figure"))
)


def _listed(c: Corpus) -> DataFrame:
    """The tables of the first chunks' documents and the images of their pages, with captions."""
    captions = layout.nearest_caption(_elements(c)).select((F.col("document_id") * 1000000 + F.col("page_number") * 1000 + F.col("ord")).alias("asset_id"), "caption")
    found = _found(c).withColumn("page", F.coalesce("page", F.lit(1)))
    tables = context.context_tables(found, _assets(c, "Table")).withColumn("kind", F.lit("table"))
    images = context.context_images(found, _assets(c, "Picture", "Figure")).withColumn("kind", F.lit("image"))
    return tables.unionByName(images).join(captions, "asset_id").select("query_id", "kind", "asset_id", "caption")


query(
    "context_assets",
    f"""SELECT c.query_id, context || coalesce(chr(10) || chr(10) || 'Available tables:' || chr(10) || t.lines, '') || coalesce(chr(10) || chr(10) || 'Available images:' || chr(10) || i.lines, '') AS context FROM ({_CONTEXT}) c
    LEFT JOIN (SELECT query_id, string_agg('- TABLA_' || asset_id || ': ' || caption, chr(10) ORDER BY asset_id) AS lines FROM (SELECT DISTINCT query_id, document_id FROM found WHERE rank <= 3) h
      JOIN (SELECT document_id, caption, {_ASSET} FROM near_caps WHERE class = 'Table') n USING (document_id) GROUP BY query_id) t USING (query_id)
    LEFT JOIN (SELECT query_id, string_agg('- IMAGEN_' || asset_id || ': ' || caption, chr(10) ORDER BY asset_id) AS lines FROM (SELECT DISTINCT query_id, document_id FROM found WHERE rank <= 3) h
      JOIN (SELECT document_id, caption, {_ASSET} FROM near_caps WHERE class IN ('Picture', 'Figure') AND page_number = 1) n USING (document_id) GROUP BY query_id) i USING (query_id)""",
)(lambda c: context.with_assets(context.build_context(_found(c), c.documents), _listed(c)))
query(
    "asset_captions",
    f"""SELECT {_E}, CASE WHEN caption = '' OR starts_with(caption, 'Tabla ') OR starts_with(caption, 'Imagen ') THEN 'doc ' || document_id || ' p' || page_number ELSE caption END AS caption FROM (SELECT {_E}, CASE WHEN ord % 3 = 0 THEN 'Tabla 3' ELSE caption END AS caption FROM near_caps)""",
)(lambda c: layout.nearest_caption(_elements(c)).select("document_id", "page_number", "ord", context.asset_caption(F.when(F.col("ord") % 3 == 0, "Tabla 3").otherwise(F.col("caption")), F.concat(F.lit("t/doc_"), "document_id", F.lit("_p"), "page_number", F.lit(".png"))).alias("caption")))
query("answer_sources", "SELECT query_id, rank, document_id, chunk_index, title, left(content, 200) AS preview FROM found JOIN docs USING (document_id) WHERE rank <= 5")(lambda c: context.answer_sources(_found(c), c.documents))


def _answers(c: Corpus) -> DataFrame:
    rows = c.messages.where("message_type = 'assistant'")
    refs = F.concat("content", F.lit(" see Table "), F.col("session_id") % 9 + 1, F.lit("-"), F.col("seq") % 9 + 1, F.lit(" and TABLA_"), F.col("session_id") % 20)
    return rows.select((F.col("session_id") * 1000 + F.col("seq")).alias("answer_id"), refs.alias("text"))


def _captioned(c: Corpus) -> DataFrame:
    """Assets of benchmark items: numbers in captions and in file names."""
    i = F.col("item_id")
    caption = F.concat(F.lit("Table "), i % 11 + 1, F.lit("-"), F.floor(i / 11) % 12 + 1, F.lit(" "), F.left("text", F.lit(20)))
    name = F.concat(F.lit("tab_"), i % 7 + 1, F.lit("-"), i % 5 + 1, F.lit(".png"))
    return c.table("benchmark").select(i.alias("asset_id"), F.lit("table").alias("kind"), caption.alias("caption"), name.alias("file_name"), F.concat(F.lit("extracted_tables/"), name).alias("path"))


query("marker_links", "SELECT conv_id * 1000 + turn AS answer_id, 'TABLA_' || (conv_id % 20) AS marker, item_id AS asset_id FROM conversations JOIN benchmark ON item_id = conv_id % 20 WHERE role = 'assistant'")(lambda c: context.marker_links(_answers(c), _captioned(c)))
_NUMBERED = """SELECT DISTINCT conv_id * 1000 + turn AS answer_id, (conv_id % 9 + 1) || '-' || (turn % 9 + 1) AS ref, item_id AS asset_id FROM conversations JOIN benchmark
    ON (item_id % 11 = conv_id % 9 AND (item_id // 11) % 12 = turn % 9) OR (item_id % 7 = conv_id % 9 AND item_id % 5 = turn % 9) WHERE role = 'assistant'"""
query("reference_links", _NUMBERED)(lambda c: context.reference_links(_answers(c), _captioned(c)))
query(
    "answer_blocks",
    f"""WITH blocks AS (SELECT item_id AS asset_id, chr(10) || chr(10) || '![Table ' || (item_id % 11 + 1) || '-' || ((item_id // 11) % 12 + 1) || ' ' || left(text, 20) || '](extracted_tables/tab_' || (item_id % 7 + 1) || '-' || (item_id % 5 + 1) || '.png)' || chr(10) || chr(10) AS block FROM benchmark),
    given AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id % 20 AS marked, text || ' see Table ' || (conv_id % 9 + 1) || '-' || (turn % 9 + 1) || ' and TABLA_' || (conv_id % 20) AS text FROM conversations WHERE role = 'assistant'),
    behind AS (SELECT answer_id, string_agg(block, '' ORDER BY asset_id) AS b FROM ({_NUMBERED}) JOIN blocks USING (asset_id) JOIN given USING (answer_id) WHERE asset_id <> marked GROUP BY answer_id)
    SELECT answer_id, CASE WHEN k.block IS NULL THEN text ELSE replace(text, 'TABLA_' || marked, k.block) END || coalesce(b, '') AS text FROM given LEFT JOIN blocks k ON k.asset_id = marked LEFT JOIN behind USING (answer_id)""",
)(lambda c: context.answer_blocks(_answers(c), _captioned(c)))

# --------------------------------------------------------------------------------------------------- conversations

query("conversation_history", "SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS place FROM messages WHERE regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''")(lambda c: conversations.conversation_history(c.messages))
query("conversation_recency", "SELECT *, CAST(dense_rank() OVER (ORDER BY last_seq DESC) AS INTEGER) AS recency FROM (SELECT session_id, max(seq) AS last_seq, count(*) AS n_messages FROM messages GROUP BY session_id)")(lambda c: conversations.conversation_recency(c.messages))
query("chunk_usage", "SELECT document_id, chunk_index, count(DISTINCT query_id) AS used_in_messages FROM found GROUP BY ALL")(lambda c: conversations.chunk_usage(_found(c).select(F.col("query_id").alias("message_id"), "document_id", "chunk_index")))
query("entity_counts", "SELECT 'documents' AS entity, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'conversations', count(DISTINCT session_id) FROM messages UNION ALL SELECT 'messages', count(*) FROM messages")(
    lambda c: conversations.entity_counts({"documents": c.documents, "chunks": c.chunks, "conversations": c.messages.select("session_id").distinct(), "messages": c.messages})
)
query("message_search", "SELECT session_id, seq, CASE WHEN length(content) <= 100 THEN content ELSE left(content, 100) || '...' END AS preview FROM messages WHERE message_type = 'user' AND contains(lower(content), 'the')")(lambda c: conversations.message_search(c.messages, "user", "The"))

# --------------------------------------------------------------------------------------------------------- catalog

query("route_files", "SELECT url AS path, CASE WHEN x = '.pdf' THEN 'pdf' WHEN x IN ('.png', '.jpg', '.jpeg', '.tiff', '.bmp') THEN 'image' ELSE 'error' END AS route FROM (SELECT url, lower(regexp_extract(url, '\\.[^./]+$', 0)) AS x FROM (SELECT url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '' END AS url FROM pages))")(
    lambda c: catalog.route_files(c.table("pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".png").otherwise("")).alias("path")))
)
query("default_title", "SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'doc_' || document_id ELSE title END AS title FROM docs")(
    lambda c: c.documents.select("document_id", catalog.default_title(F.when(F.col("document_id") % 4 == 0, " ").otherwise(F.col("title")), F.concat(F.lit("doc_"), "document_id", F.lit(".md"))).alias("title"))
)
query("dashboard", "SELECT * FROM (SELECT count(*) AS n_documents, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS processing FROM docs), (SELECT count(*) AS n_chunks, count(*) FILTER (WHERE indexed) AS n_indexed FROM chunks)")(
    lambda c: catalog.dashboard(c.documents, c.chunks)
)
query("recent_documents", "SELECT document_id, title, status FROM docs ORDER BY created_at DESC, document_id DESC LIMIT 10")(lambda c: catalog.recent_documents(c.documents).select("document_id", "title", "status"))
query("recent_logs", "SELECT log_id, document_id, level, message FROM logs ORDER BY created_at DESC, log_id DESC LIMIT 20")(lambda c: catalog.recent_logs(c.logs).select("log_id", "document_id", "level", "message"))


@query(
    "document_counts",
    "SELECT document_id, title, (SELECT count(*) FROM raw_pages p WHERE p.document_id = d.document_id) AS n_pages, (SELECT count(*) FROM elements e WHERE e.document_id = d.document_id AND class = 'Picture') AS n_images, (SELECT count(*) FROM elements e WHERE e.document_id = d.document_id AND class = 'Table') AS n_tables, (SELECT count(*) FROM chunks k WHERE k.document_id = d.document_id) AS n_chunks FROM docs d WHERE status IN ('completed', 'failed')",
)
def document_counts(c: Corpus) -> DataFrame:
    children = {"pages": c.pages, "images": _assets(c, "Picture"), "tables": _assets(c, "Table"), "chunks": c.chunks}
    return catalog.document_counts(c.documents.select("document_id", "title", "status"), children, ["completed", "failed"]).drop("status")


_KINDS = {"pages": "raw_pages", "images": "elements WHERE class = 'Picture'", "tables": "elements WHERE class = 'Table'", "chunks": "chunks"}
_COUNTS = " ".join(f"LEFT JOIN (SELECT document_id, count(*) AS {kind} FROM {rows} GROUP BY document_id) USING (document_id)" for kind, rows in _KINDS.items())


@query("stage_totals", f"SELECT document_id, title, {', '.join(f'coalesce({kind}, 0) AS total_{kind}' for kind in _KINDS)} FROM docs {_COUNTS}")
def stage_totals(c: Corpus) -> DataFrame:
    children = {"pages": c.pages, "images": _assets(c, "Picture"), "tables": _assets(c, "Table"), "chunks": c.chunks}
    return catalog.stage_totals(c.documents.select("document_id", "title"), children)


query("document_detail", "SELECT document_id, chunk_index, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS nth FROM chunks) WHERE nth <= 50")(lambda c: catalog.first_of_each(c.chunks.select("document_id", "chunk_index"), 50, "chunk_index"))
query("document_status", "SELECT document_id, status, coalesce((SELECT string_agg(message, ' | ' ORDER BY nth) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, log_id DESC) AS nth FROM logs) l WHERE l.document_id = d.document_id AND nth <= 5), '') AS messages FROM docs d")(
    lambda c: catalog.document_status(c.documents.select("document_id", "status"), c.logs)
)
query("chunk_detail", "SELECT document_id, chunk_index, title, content, indexed FROM chunks JOIN docs USING (document_id) WHERE document_id = 3 AND chunk_index = 0")(lambda c: catalog.chunk_detail(c.chunks, c.documents, 3, 0).select("document_id", "chunk_index", "title", "content", "indexed"))
query("processing_time", "SELECT document_id, epoch_us(completed_at - started_at) / 1e6 AS seconds FROM docs")(lambda c: catalog.processing_time(c.documents).select("document_id", "seconds"))
query("has_content", "SELECT document_id, document_id IN (SELECT document_id FROM elements WHERE class IN ('Picture', 'Table')) AS has_content FROM docs")(lambda c: catalog.has_content(c.documents, [_assets(c, "Picture"), _assets(c, "Table")]))
query("indexed_per_document", "SELECT document_id, count(*) AS n_chunks, count(*) FILTER (WHERE indexed) AS n_indexed FROM chunks GROUP BY document_id")(lambda c: catalog.indexed_per_document(c.chunks))
query("health_flags", "SELECT *, CASE WHEN n_chunks > 0 AND n_indexed = 0 THEN 'warning' WHEN n_pending = 0 AND n_chunks = n_indexed THEN 'good' ELSE 'pending' END AS flag FROM (SELECT count(*) FILTER (WHERE status <> 'completed') AS n_pending FROM docs), (SELECT count(*) AS n_chunks, count(*) FILTER (WHERE indexed) AS n_indexed FROM chunks)")(
    lambda c: catalog.health_flags(c.documents, c.chunks)
)
query("index_consistency", "SELECT 'catalog' AS side, 'doc_' || document_id || '_chunk_' || chunk_index AS id FROM chunks WHERE indexed UNION ALL SELECT 'collection', id FROM entries")(lambda c: catalog.index_consistency(c.chunks, c.collection))
query("page_assets", "SELECT p.document_id, p.page_number, CAST(length(raw) AS INTEGER) AS n_chars, count(*) FILTER (WHERE class = 'Picture') AS n_images, count(*) FILTER (WHERE class = 'Table') AS n_tables FROM raw_pages p JOIN elements USING (document_id, page_number) GROUP BY ALL")(
    lambda c: catalog.page_assets(c.pages, _assets(c, "Picture"), _assets(c, "Table"))
)
query("key_violations", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")(lambda c: catalog.key_violations(c.table("documents"), ["text"]))
query("admin_search", "SELECT document_id, title, status FROM docs WHERE (contains(lower(title), 'src1') OR contains(lower(status), 'src1')) AND status = 'completed'")(
    lambda c: catalog.admin_search(c.documents.select("document_id", "title", "status"), ["title", "status"], "SRC1", status="completed")
)


def _some_documents(c: Corpus) -> DataFrame:
    return c.documents.where("document_id % 5 = 0").select("document_id")


@query("cascade_delete", "SELECT 'documents' AS part, count(*) AS n FROM docs WHERE document_id % 5 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id % 5 <> 0 UNION ALL SELECT 'entries', count(*) FROM entries WHERE NOT (vec_id % 5 = 0 AND vec_id IN (SELECT document_id FROM docs))")
def cascade_delete(c: Corpus) -> DataFrame:
    left, entries = catalog.cascade_delete({"documents": c.documents, "chunks": c.chunks}, c.collection, _some_documents(c))
    return conversations.entity_counts(left | {"entries": entries}).withColumnRenamed("entity", "part")


query("reprocess_reset", "SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'uploaded' ELSE status END AS status, document_id % 5 = 0 AS cleared FROM docs")(lambda c: catalog.reprocess_reset(c.documents, _some_documents(c)).select("document_id", "status", F.col("started_at").isNull().alias("cleared")))
query("reindex_reset", "SELECT document_id, 'uploaded' AS status, false AS indexing_done FROM docs WHERE status = 'completed'")(lambda c: catalog.reindex_reset(c.documents).select("document_id", "status", "indexing_done"))
query("mark_unindexed", "SELECT document_id, chunk_index, false AS indexed, CAST(NULL AS VARCHAR) AS external_id FROM chunks")(lambda c: catalog.mark_unindexed(c.chunks).select("document_id", "chunk_index", "indexed", "external_id"))
query("mark_indexed", "SELECT k.document_id, k.chunk_index, k.indexed OR e.id IS NOT NULL AS indexed, e.id AS external_id FROM chunks k LEFT JOIN entries e ON e.id = 'doc_' || k.document_id || '_chunk_' || k.chunk_index")(lambda c: catalog.mark_indexed(c.chunks, c.collection).select("document_id", "chunk_index", "indexed", "external_id"))
query(
    "pipeline_state",
    "SELECT document_id, arg_max(stage, o) AS stage, arg_max(level, o) AS level, arg_min(message, o) FILTER (WHERE level = 'error') AS first_error FROM (SELECT *, row_number() OVER (ORDER BY created_at, log_id) AS o FROM logs) GROUP BY document_id",
)(lambda c: catalog.pipeline_state(c.logs))
_PROGRESS = """SELECT *, CASE stage WHEN 'parsing' THEN CASE level WHEN 'success' THEN 30 ELSE 10 END WHEN 'chunking' THEN CASE level WHEN 'success' THEN 50 ELSE 35 END WHEN 'embedding' THEN CASE level WHEN 'success' THEN 75 ELSE 55 END ELSE CASE level WHEN 'success' THEN 100 ELSE 80 END END AS percent
  FROM (SELECT document_id, arg_max(stage, o) AS stage, arg_max(level, o) AS level, arg_min(message, o) FILTER (WHERE level = 'error') AS first_error FROM (SELECT *, row_number() OVER (ORDER BY created_at, log_id) AS o FROM logs) GROUP BY document_id)"""
query("pipeline_progress", _PROGRESS)(lambda c: progress.pipeline_progress(c.logs))


@query("progress_stream", _PROGRESS)
def progress_stream(c: Corpus) -> DataFrame:
    """The same rows from the log table as a stream, run to its end."""
    place = f"{shared_folder(c.spark)}/progress-{uuid.uuid4().hex}"
    progress.progress_stream(c.log_stream, f"{place}/rows", f"{place}/checkpoint", late="10000 days").awaitTermination()
    return progress.latest_progress(c.spark, f"{place}/rows")


query("log_report", "SELECT stage, level, count(*) AS n FROM logs GROUP BY ALL")(lambda c: catalog.log_report(c.logs))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to answers: markdown, hybrid chunks, vectors, the three nearest chunks of each benchmark text."""
    c = Corpus(spark, sf_dir)
    chunks = vectors.embed(chunking.chunk_documents(c.markdown, HYBRID).select("document_id", "chunk_index", "content"), "content")
    entries = chunks.select(collection.entry_id().alias("id"), "embedding", F.col("content").alias("document"))
    asked = vectors.embed(c.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    return search.knn(asked, entries, 3, keep=("document",))


query("rag_flow", _text_near_sql(f"SELECT 'doc_' || document_id || '_chunk_' || chunk_index AS id, content AS text FROM ({_HYBRID_SQL})", "document"))(lambda c: flagship(c.spark, c.sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_sql(sql) for name, (_, sql) in QUERIES.items() if sql}
