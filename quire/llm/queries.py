"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import collocations, decontamination, embedding_dedup, exact_dedup, line_dedup, minhash, mixing, quality, suffix_dedup, token_counts, toxicity, url_filter, vector_codes
from quire.llm.common import table

#: Tokens over which a document is marked.
TOKEN_LIMIT = 4096


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept", "recall")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair with a shingle in common is counted, components are reached step by step; for tables of the tests' size.
OP3_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM worded WHERE len(words) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT doc_id, b FROM reached JOIN both_ways ON a = other
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN components USING (doc_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.line_dedup(docs)
    return done.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


OP4_SQL = f"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), normed AS (
  SELECT doc_id, line_no, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM every
), firsts AS (
  SELECT norm, min(doc_id * 100000000 + line_no) AS place FROM normed WHERE norm <> '' GROUP BY norm
), long_lines AS (
  SELECT norm, place, string_split(norm, ' ') AS words, len(string_split(norm, ' ')) AS n FROM firsts
), variants AS (
  SELECT norm, place, n - 1 AS m, i, array_to_string(words[1:i - 1], ' ') AS a, array_to_string(words[i + 1:n], ' ') AS b
  FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM long_lines WHERE n >= {line_dedup.MIN_WORDS})
  UNION ALL
  SELECT norm, place, n, i, array_to_string(words[1:i - 1], ' '), array_to_string(words[i:n], ' ')
  FROM (SELECT *, unnest(generate_series(1, n + 1)) AS i FROM long_lines WHERE n >= {line_dedup.MIN_WORDS})
), earliest AS (
  SELECT m, i, a, b, min(place) AS place FROM variants GROUP BY m, i, a, b HAVING count(*) > 1
), near AS (
  SELECT DISTINCT v.norm FROM variants v JOIN earliest e USING (m, i, a, b) WHERE e.place < v.place
), judged AS (
  SELECT x.doc_id, x.line_no, x.line,
    CASE WHEN x.norm = '' THEN 0 WHEN f.place < x.doc_id * 100000000 + x.line_no THEN 1 WHEN x.norm IN (SELECT norm FROM near) THEN 2 ELSE 0 END AS goes
  FROM normed x LEFT JOIN firsts f USING (norm)
), kept AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE goes = 1) AS INTEGER) AS n_exact, CAST(count(*) FILTER (WHERE goes = 2) AS INTEGER) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE goes = 0), '') AS kept_text
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_lines, n_exact, n_near, CAST(length(kept_text) AS BIGINT) AS n_chars_kept, md5(kept_text) AS kept_md5 FROM kept
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, piece_model()).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6's result that SQL can say: sizes and targets."""
    return op6_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: Sources in the order of limit by weight; those before the first whose limit the level of the rest doesn't reach are full.
MIX_TARGETS_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, 2 * source_size / weight) AS level FROM levels WHERE 2 * source_size >= level * weight
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(least(2.0 :: DOUBLE * source_size, weight * level), 4) AS target
FROM sized JOIN weighed ON sized.source IS NOT DISTINCT FROM weighed.source, level
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score", "held_out")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8's result that SQL can say: what rules judge; rule_verdict is null where trees do."""
    return url_filter.ruled(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


_RULES_SQL = ", ".join(f"('{said}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for said, rule in url_filter.RULES)
URL_RULES_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{url_filter._UPPER}', '{url_filter._LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rests
), fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS rule_verdict
  FROM named JOIN (VALUES {_RULES_SQL}) AS rules(said, rule, site, start) ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id
)
SELECT page_id, host, path, rule, rule_verdict FROM named LEFT JOIN fitting USING (page_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    leaks = {"contaminated": F.size("leaks") > 0, "n_items": F.size("leaks").cast("long"), "items": F.transform("leaks", lambda x: x["item"]), "least_distance": F.array_min(F.transform("leaks", lambda x: x["distance"]))}
    return found.withColumns(leaks).select("doc_id", *leaks)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs)


OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang
), starts AS MATERIALIZED (
  SELECT lang, s[1] AS x, s[2] AS y, s[3] AS z FROM (SELECT lang, unnest(list_zip(words, words[2:], words[3:])) AS s FROM worded)
), counts AS MATERIALIZED (
  SELECT lang, 1 AS k, x AS gram, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM starts WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM starts WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10
), parts AS MATERIALIZED (
  SELECT lang, k, gram, f, cut, array_to_string(string_split(gram, ' ')[1:cut], ' ') AS part, array_to_string(string_split(gram, ' ')[cut + 1:k], ' ') AS rest FROM counts, (VALUES (1), (2)) AS cs(cut) WHERE cut < k
), cuts AS (
  SELECT p.lang, p.k, p.gram, p.f AS a, cut, x.f AS l, y.f AS r, (1000000 :: HUGEINT * p.f * p.f) // (x.f :: HUGEINT * y.f) AS score
  FROM parts p JOIN counts x ON x.lang || ' ' || x.gram = p.lang || ' ' || p.part JOIN counts y ON y.lang || ' ' || y.gram = p.lang || ' ' || p.rest
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, gram, max(f) AS f FROM (SELECT lang, part AS gram, f FROM parts WHERE k = 3 AND cut = 2 UNION ALL SELECT lang, rest, f FROM parts WHERE k = 3 AND cut = 1) GROUP BY ALL
), ranked AS (
  SELECT s.lang, gram AS phrase, a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, gram) AS rank
  FROM scored s LEFT JOIN longer o USING (lang, gram) WHERE o.f IS NULL OR 100 * o.f < 50 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.compress(vectors)


def _op12_sql() -> str:
    """Every round is a step of its own: the nearest entries of the last codebooks, then the means of what they took."""
    steps = ["""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), cells AS (
  SELECT vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, range(8) AS ps(p)
), book0 AS (
  SELECT p, e, x AS c FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id)
)"""]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{k} AS (
  SELECT vec_id, p, e, d, x FROM (SELECT vec_id, p, e, x, list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM cells JOIN book{k} USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""sums{k} AS (
  SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(generate_series(1, len(x))) AS i FROM near{k}) GROUP BY ALL
), new{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} n USING (p, e)
)""")
    k = vector_codes.ROUNDS
    steps.append(f"""digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{k}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{k} GROUP BY vec_id
)""")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs)


OP13_SQL = """
WITH normed AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), judged AS (
  SELECT doc_id, norm, first(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM normed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM judged
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_embedding_dedup, op2_suffix_dedup, op3_minhash_dedup, op4_line_dedup, op5_token_counts, op6_mix_sources, op7_toxicity, op8_url_filter, op9_decontamination, op10_quality, op11_collocations, op12_vector_codes, op13_exact_dedup, mix_targets, url_rules)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op11_collocations": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_exact_dedup": OP13_SQL, "mix_targets": MIX_TARGETS_SQL, "url_rules": URL_RULES_SQL}
