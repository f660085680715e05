"""The catalog, pages, chunks and collections that the queries run on, derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ordered_join

STATUSES = ("uploaded", "parsing", "chunking", "embedding", "indexing", "completed", "failed")
CLASSES = ("Title", "Text", "Picture", "Caption", "Table", "List-item", "Footnote", "Page-footer", "Text", "Caption")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


class Corpus:
    """DataFrames over the tables of a folder; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """(document_id, i, line) of every line of every document, from 0."""
        return self.table("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))

    @cached_property
    def markdown(self) -> DataFrame:
        """(document_id, source_file, markdown) with page marks and headings between the lines."""
        i = F.col("i")
        page = F.when(i % 12 == 0, F.concat(F.lit("\n\n## Página "), F.floor(i / 12) + 1, F.lit("\n\n"))).otherwise("")
        head = F.when(i % 6 == 0, F.concat(F.lit("## Sección "), i, F.lit("\n\n"))).otherwise("")
        body = self.lines.groupBy("document_id").agg(ordered_join(i, F.concat(page, head, "line", F.lit("\n\n")), "").alias("b"))
        name = F.concat(F.lit("doc_"), "document_id")
        return body.select("document_id", F.concat(name, F.lit(".md")).alias("source_file"), F.concat(F.lit("# "), name, F.lit("\n\n"), "b").alias("markdown"))

    @cached_property
    def pages(self) -> DataFrame:
        """(document_id, page_number, raw): tagged page text of which the order isn't the reading order."""
        i, d = F.col("i"), F.col("document_id")
        y, x = ((i * 7) % 20) / 20, ((d + i) % 3) / 10
        tag = lambda a, b: F.concat(F.lit("<x_"), F.format_string("%.2f", a), F.lit("><y_"), F.format_string("%.2f", b), F.lit(">"))
        element = F.concat(tag(x, y), "line", tag(x + 0.5, y + 0.04), F.lit("<class_"), _pick(CLASSES, i + d), F.lit(">"))
        return self.lines.groupBy("document_id", (F.floor(i / 20) + 1).cast("int").alias("page_number")).agg(ordered_join(i, element, "\n").alias("raw"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Catalog chunks, one for each line."""
        i = F.col("i")
        return self.lines.select(
            "document_id", i.alias("chunk_index"), F.format_string("chunk_%04d", i).alias("chunk_id"), F.col("line").alias("content"), F.length("line").alias("length"),
            F.when(i >= 3, (F.floor(i / 12) + 1).cast("int")).alias("page"), F.when(i % 6 < 3, F.concat(F.lit("Sección "), (i - i % 6))).alias("section_title"),
            F.when(i % 3 == 0, "hybrid_split").otherwise("hybrid_semantic").alias("strategy"), F.concat(F.lit("doc_"), "document_id", F.lit(".md")).alias("source_file"), (i % 5 != 0).alias("indexed"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        d = F.col("doc_id")
        created = F.timestamp_seconds(F.lit(1767225600) + d * 60)
        started = F.timestamp_seconds(F.lit(1767225600) + d * 60 + 30)
        completed = F.when(d % 7 == 5, F.timestamp_seconds(F.lit(1767225600) + d * 60 + 30 + F.col("n_chars") % 600))
        return self.table("documents").select(d.alias("document_id"), F.concat("source", F.lit("_"), d).alias("title"), _pick(STATUSES, d).alias("status"), created.alias("created_at"), started.alias("started_at"), completed.alias("completed_at"))

    @cached_property
    def collection(self) -> DataFrame:
        """Entries with vectors, typed columns and a map of further keys."""
        docs = self.table("documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source", F.col("n_chars").alias("length"))
        rows = self.table("embeddings").join(docs, "vec_id", "left")
        return rows.select(
            F.concat(F.lit("c"), F.col("label") % 3).alias("collection"), F.concat(F.lit("doc_"), "vec_id", F.lit("_chunk_0")).alias("id"), F.col("vec_id"), "embedding", F.coalesce("text", F.lit("")).alias("document"),
            "label", "lang", "source", "length", F.create_map(F.lit("half"), (F.col("vec_id") % 2).cast("string"), F.lit("lang"), F.col("lang")).alias("extra"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    @cached_property
    def questions(self) -> DataFrame:
        """(query_id, text) of benchmark items."""
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    def _logs(self, events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        level = F.when(kind == "error", "error").when(kind == "click", "warning").when(kind == "purchase", "success").otherwise("info")
        return events.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("log_id"), level.alias("level"), _pick(("parsing", "chunking", "embedding", "indexing"), F.col("event_id")).alias("stage"), F.concat(kind, F.lit(" "), "event_id").alias("message"), F.col("ts").alias("created_at"))

    @cached_property
    def logs(self) -> DataFrame:
        return self._logs(self.table("events"))

    @cached_property
    def log_stream(self) -> DataFrame:
        """The logs as a stream of the files of their table."""
        schema = self.table("events").schema
        return self._logs(self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir))

    @cached_property
    def timings(self) -> DataFrame:
        from pyspark.sql import Window

        page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return self.table("events").select(F.col("user_id").alias("document_id"), page.alias("page_number"), F.col("value").alias("elapsed"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").where("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("message_type"), F.col("text").alias("content"))


#: The same in DuckDB's SQL, by name; a definition may use those before it.
SQL = {
    "doc_lines": "SELECT doc_id AS document_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i, unnest(string_split(text, chr(10))) AS line FROM documents",
    "markdown": """SELECT document_id, 'doc_' || document_id || '.md' AS source_file, '# doc_' || document_id || chr(10) || chr(10) || string_agg(
        CASE WHEN i % 12 = 0 THEN chr(10) || chr(10) || '## Página ' || (i // 12 + 1) || chr(10) || chr(10) ELSE '' END || CASE WHEN i % 6 = 0 THEN '## Sección ' || i || chr(10) || chr(10) ELSE '' END || line || chr(10) || chr(10), '' ORDER BY i) AS markdown
        FROM doc_lines GROUP BY document_id""",
    "elements": """SELECT document_id, CAST(i // 20 + 1 AS INTEGER) AS page_number, CAST(i % 20 AS INTEGER) AS ord, CAST(printf('%.2f', ((document_id + i) % 3) / 10) AS DOUBLE) AS x1, CAST(printf('%.2f', ((i * 7) % 20) / 20) AS DOUBLE) AS y1,
        CAST(printf('%.2f', ((document_id + i) % 3) / 10 + 0.5) AS DOUBLE) AS x2, CAST(printf('%.2f', ((i * 7) % 20) / 20 + 0.04) AS DOUBLE) AS y2,
        (['Title','Text','Picture','Caption','Table','List-item','Footnote','Page-footer','Text','Caption'])[CAST((i + document_id) % 10 AS INTEGER) + 1] AS class, line AS content FROM doc_lines""",
    "raw_pages": """SELECT document_id, page_number, string_agg('<x_' || printf('%.2f', x1) || '><y_' || printf('%.2f', y1) || '>' || content || '<x_' || printf('%.2f', x2) || '><y_' || printf('%.2f', y2) || '><class_' || class || '>', chr(10) ORDER BY ord) AS raw
        FROM elements GROUP BY document_id, page_number""",
    "ordered": "SELECT *, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY y1, x1, ord) - 1 AS INTEGER) AS pos, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c FROM elements",
    "figs": "SELECT *, document_id || '_p' || page_number || '_fig' || row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) || '.png' AS figure_name FROM ordered WHERE class IN ('Picture', 'Figure')",
    "fig_caps": """SELECT document_id, page_number, pos, CAST(class <> 'Caption' AS INTEGER) AS late, CASE WHEN class = 'Caption' AND b IS NOT NULL THEN '![' || c || '](figures/' || b || ')' || chr(10) || chr(10) WHEN class = 'Caption' THEN c || chr(10) || chr(10)
        WHEN a IS NULL THEN '![Figura](figures/' || figure_name || ')' || chr(10) || chr(10) END AS md FROM (SELECT o.*, f.figure_name, lag(f.figure_name) OVER w AS b, lead(o.class) OVER w AS a FROM ordered o LEFT JOIN figs f USING (document_id, page_number, pos)
        WHERE o.class IN ('Picture', 'Figure', 'Caption') WINDOW w AS (PARTITION BY document_id, page_number ORDER BY pos))""",
    "rendered": """SELECT document_id, page_number, pos, class, CASE WHEN class = 'List-item' THEN '- ' || c || chr(10) WHEN class IN ('Title', 'Section-header') THEN '## ' || c || chr(10) || chr(10) WHEN class = 'Footnote' THEN '_' || c || '_' || chr(10) || chr(10)
        WHEN class = 'Page-footer' THEN '' ELSE c || chr(10) || chr(10) END AS md FROM ordered WHERE class NOT IN ('Picture', 'Figure')""",
    "near_caps": """SELECT a.document_id, a.page_number, a.ord, a.class, coalesce((SELECT c.c FROM ordered c WHERE c.class = 'Caption' AND c.document_id = a.document_id AND c.page_number = a.page_number
        ORDER BY round((c.y1 + c.y2) / 2, 6) < round((a.y1 + a.y2) / 2, 6), round(abs(round((c.y1 + c.y2) / 2, 6) - round((a.y1 + a.y2) / 2, 6)), 6), c.ord LIMIT 1), '') AS caption FROM elements a WHERE a.class IN ('Table', 'Picture', 'Figure')""",
    "chunks": """SELECT document_id, i AS chunk_index, printf('chunk_%04d', i) AS chunk_id, line AS content, CAST(length(line) AS INTEGER) AS length, CASE WHEN i >= 3 THEN CAST(i // 12 + 1 AS INTEGER) END AS page, CASE WHEN i % 6 < 3 THEN 'Sección ' || (i - i % 6) END AS section_title,
        CASE WHEN i % 3 = 0 THEN 'hybrid_split' ELSE 'hybrid_semantic' END AS strategy, 'doc_' || document_id || '.md' AS source_file, i % 5 <> 0 AS indexed FROM doc_lines""",
    "docs": """SELECT doc_id AS document_id, source || '_' || doc_id AS title, (['uploaded','parsing','chunking','embedding','indexing','completed','failed'])[CAST(doc_id % 7 AS INTEGER) + 1] AS status, TIMESTAMP '2026-01-01' + to_seconds(doc_id * 60) AS created_at,
        TIMESTAMP '2026-01-01' + to_seconds(doc_id * 60 + 30) AS started_at, CASE WHEN doc_id % 7 = 5 THEN TIMESTAMP '2026-01-01' + to_seconds(doc_id * 60 + 30 + n_chars % 600) END AS completed_at FROM documents""",
    "entries": """SELECT 'c' || (label % 3) AS collection, 'doc_' || vec_id || '_chunk_0' AS id, vec_id, embedding, coalesce(text, '') AS document, label, lang, source, n_chars AS length FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "sims": """SELECT q.vec_id AS query_id, e.*, round(1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS distance, round(list_dot_product(list_transform(list_zip(q.v, e.v), lambda z: z[1] - z[2]), list_transform(list_zip(q.v, e.v), lambda z: z[1] - z[2])), 6) AS l2,
        round(1 - list_dot_product(q.v, e.v), 6) AS ip FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM entries) e""",
    "knn20": "SELECT *, round(1 - distance, 6) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM sims) WHERE rank <= 20",
    "questions": "SELECT item_id AS query_id, text FROM benchmark",
    "results": "SELECT query_id, rank, id, vec_id AS document_id, 0 AS chunk_index, similarity, document FROM knn20 WHERE rank <= 10",
    "asked": "SELECT vec_id AS query_id, document AS text FROM entries WHERE vec_id % 20 = 0",
    "reranked": """SELECT *, rank - new_rank AS rank_change, similarity AS original_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS new_rank FROM (
        SELECT r.*, a.text, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains(string_split(lower(r.document), ' '), x))) / len(w) END, 6) AS rerank_score
        FROM results r JOIN (SELECT *, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM asked) a USING (query_id)))""",
    "found": "SELECT r.query_id, r.rank, c.* FROM results r JOIN chunks c USING (document_id, chunk_index) WHERE length(c.content) >= 100",
    "logs": """SELECT user_id AS document_id, event_id AS log_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level, (['parsing','chunking','embedding','indexing'])[CAST(event_id % 4 AS INTEGER) + 1] AS stage,
        event_type || ' ' || event_id AS message, ts AS created_at FROM events""",
    "timings": "SELECT user_id AS document_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS page_number, value AS elapsed FROM events",
    "messages": "SELECT conv_id AS session_id, turn AS seq, role AS message_type, text AS content FROM conversations WHERE role <> 'system'",
}


def with_sql(select: str) -> str:
    """A SELECT with the definitions that it uses, directly or through others, in front."""
    import re

    needed: set[str] = set()
    queue = [select]
    while queue:
        text = queue.pop()
        for name in SQL:
            if name not in needed and re.search(rf"(?i)\b(?:from|join|,)\s+{name}\b", text):
                needed.add(name)
                queue.append(SQL[name])
    given = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    return f"WITH {given} {select}" if given else select
