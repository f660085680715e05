"""From search results to answer contexts, and from answers to the assets they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ordered_join, strip, word_count

#: A reference such as Table 1-2: the words for it, and hyphens that may stand between the numbers. Fixed values.
TABLE_WORDS, IMAGE_WORDS = "tabla|table", "imagen|image|figura|figure"
_REF = r"(?i)\b(?:{})\s+([0-9]+)[-‑]([0-9]+)\b"
_NUMBERS = r"([0-9]+)[-‑]([0-9]+)"


def retrieve_chunks(results: DataFrame, chunks: DataFrame, first: int = 10, least: int = 100) -> DataFrame:
    """Chunks of the first results, in their ranks; short ones are dropped after the cut."""
    return results.where(F.col("rank") <= first).join(chunks, ["document_id", "chunk_index"]).where(F.length("content") >= least)


def build_context(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, context): titles and texts in the order of the ranks."""
    rows = found.join(documents.select("document_id", "title"), "document_id")
    block = F.concat(F.lit("Documento: "), "title", F.lit("\n"), "content")
    return rows.groupBy("query_id").agg(ordered_join(F.col("rank"), block, "\n\n").alias("context"))


def with_assets(contexts: DataFrame, assets: DataFrame) -> DataFrame:
    """Contexts (query_id, context) with the lists of the tables and images that an answer may show.

    assets are (query_id, kind, asset_id, caption), kind table or image; each stands under the marker that
    marker_links and answer_blocks look for, in the order of the ids.
    """
    out = contexts
    for kind, word, name in (("table", "TABLA_", "tables"), ("image", "IMAGEN_", "images")):
        line = F.concat(F.lit(f"- {word}"), "asset_id", F.lit(": "), F.coalesce("caption", F.lit("")))
        listed = assets.where(F.col("kind") == kind).groupBy("query_id").agg(ordered_join(F.col("asset_id"), line, "\n").alias("listed"))
        more = F.coalesce(F.concat(F.lit(f"\n\nAvailable {name}:\n"), "listed"), F.lit(""))
        out = out.join(listed, "query_id", "left").select("query_id", F.concat("context", more).alias("context"))
    return out


def build_prompt(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, prompt); queries without a context get the other form."""
    rows = queries.join(contexts, "query_id", "left")
    some = F.concat(F.lit("Contexto:\n"), "context", F.lit("\n\nPregunta: "), "text")
    return rows.select("query_id", F.coalesce(some, F.concat(F.lit("Pregunta: "), "text", F.lit("\n\nNo hay documentos."))).alias("prompt"))


def context_tagged(found: DataFrame) -> DataFrame:
    """(query_id, context): chunks under a line with their number and page."""
    block = F.concat(F.lit("[Chunk "), "rank", F.lit(", Página "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")), F.lit("]\n"), "content")
    return found.groupBy("query_id").agg(ordered_join(F.col("rank"), block, "\n\n---\n\n").alias("context"))


def four_places(score: Column) -> Column:
    """A number with four places, rounded from the exact value that the double holds, as C and Python print it.

    A double in the middle of two such numbers is rarely the middle itself; which side it lies on is the sign of
    20000 x - n, exact if x is split into two halves of its digits first.
    """
    x = F.abs(score)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    n = F.rint(x * 20000.0)
    side = (high * 20000.0 - n) + (x - high) * 20000.0
    odd = n % 2 == 1
    down, up = F.floor(n / 2), F.floor((n + 1) / 2)
    middle = odd & (F.abs(side) < 1e-6)
    even = F.when(down % 2 == 0, down).otherwise(up)
    units = F.when(middle, F.when(side < 0, down).when(side > 0, up).otherwise(even)).otherwise(F.floor(x * 10000.0 + 0.5)).cast("long")
    return F.concat(F.when(score < 0, "-").otherwise(""), F.format_string("%d.%04d", F.floor(units / 10000), units % 10000))


def context_scored(reranked: DataFrame) -> DataFrame:
    """(query_id, context, n_documents, n_words, n_chars) of reranked documents under their scores."""
    block = F.concat(F.lit("--- Document "), F.col("new_rank"), F.lit(" (Score: "), four_places(F.col("rerank_score")), F.lit(") ---\n"), "document")
    joined = reranked.groupBy("query_id").agg(ordered_join(F.col("new_rank"), block, "\n\n").alias("context"), F.count("*").alias("n_documents"))
    return joined.withColumns({"n_words": word_count(F.col("context")), "n_chars": F.length("context")})


def context_tables(found: DataFrame, tables: DataFrame, top: int = 3) -> DataFrame:
    """Tables of the documents of the first chunks."""
    docs = found.where(F.col("rank") <= top).select("query_id", "document_id").distinct()
    return docs.join(tables, "document_id").select("query_id", "document_id", "asset_id")


def context_images(found: DataFrame, images: DataFrame, top: int = 3) -> DataFrame:
    """Images on the pages of the first chunks, each once."""
    pages = found.where((F.col("rank") <= top) & F.col("page").isNotNull()).select("query_id", "document_id", F.col("page").alias("page_number"))
    return pages.join(images, ["document_id", "page_number"]).select("query_id", "document_id", "asset_id").distinct()


def asset_caption(caption: Column, path: Column) -> Column:
    """The caption, or where it says nothing the file's name with spaces."""
    c = F.coalesce(caption, F.lit(""))
    name = strip(F.translate(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.png$", ""), "_", " "))
    return F.when((c == "") | c.startswith("Tabla ") | c.startswith("Imagen "), name).otherwise(c)


def answer_sources(found: DataFrame, documents: DataFrame, first: int = 5) -> DataFrame:
    rows = found.where(F.col("rank") <= first).join(documents.select("document_id", "title"), "document_id")
    return rows.select("query_id", "rank", "document_id", "chunk_index", "title", F.left("content", F.lit(200)).alias("preview"))


def marker_links(answers: DataFrame, assets: DataFrame) -> DataFrame:
    """(answer_id, marker, asset_id): TABLA_n and IMAGEN_n in answers, joined to assets (asset_id, kind)."""
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("((?:TABLA|IMAGEN)_[0-9]+)"), F.lit(1)))).alias("marker"))
    keyed = assets.select("asset_id", F.concat(F.when(F.col("kind") == "table", F.lit("TABLA_")).otherwise(F.lit("IMAGEN_")), "asset_id").alias("marker"))
    return found.join(keyed, "marker").select("answer_id", "marker", "asset_id")


def _refs(text: Column, pattern: str) -> Column:
    """Distinct N-M of a text, the hyphens made alike."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, pattern, 1), F.lit("-"), F.regexp_extract(m, pattern, 2))))


def reference_links(answers: DataFrame, assets: DataFrame) -> DataFrame:
    """(answer_id, ref, asset_id): numbered references of answers to assets that have the number.

    An asset has the numbers N-M of its caption and of its file name, whatever stands before them. Numbers are
    compared whole, so 1-1 is not found in 11-12. assets are (asset_id, kind, caption) and may have a file_name.
    """
    name = F.coalesce("file_name", F.lit("")) if "file_name" in assets.columns else F.lit("")
    numbers = F.explode(_refs(F.concat_ws(" ", "caption", name), _NUMBERS)).alias("ref")

    def side(kind: str, words: str) -> DataFrame:
        a = answers.select("answer_id", F.explode(_refs(F.col("text"), _REF.format(words))).alias("ref"))
        return a.join(assets.where(F.col("kind") == kind).select("asset_id", numbers), "ref").select("answer_id", "ref", "asset_id")

    return side("table", TABLE_WORDS).unionByName(side("image", IMAGE_WORDS))


def answer_blocks(answers: DataFrame, assets: DataFrame) -> DataFrame:
    """(answer_id, text): answers with the blocks of the assets that they name.

    A marker TABLA_n or IMAGEN_n becomes the asset's block; assets that are only named by a number are shown behind
    the text, in the order of their ids. A block is a markdown image: caption and path (assets: asset_id, kind,
    caption, path). Longer markers are replaced first, so none is taken for the beginning of another.
    """
    block = F.concat(F.lit("\n\n!["), F.coalesce("caption", F.lit("")), F.lit("]("), "path", F.lit(")\n\n")).alias("block")
    blocks = assets.select("asset_id", block)
    marked = marker_links(answers, assets)
    named = reference_links(answers, assets).select("answer_id", "asset_id").distinct().join(marked, ["answer_id", "asset_id"], "left_anti")
    by_length = F.struct(-F.length("marker"), F.col("marker"), F.col("block"))
    swaps = marked.join(blocks, "asset_id").groupBy("answer_id").agg(F.array_sort(F.collect_list(by_length)).alias("swaps"))
    behind = named.join(blocks, "asset_id").groupBy("answer_id").agg(ordered_join(F.col("asset_id"), F.col("block"), "").alias("behind"))
    rows = answers.select("answer_id", "text").join(swaps, "answer_id", "left").join(behind, "answer_id", "left")
    swapped = F.when(F.col("swaps").isNull(), F.col("text")).otherwise(F.aggregate("swaps", F.col("text"), lambda t, x: F.replace(t, x["marker"], x["block"])))
    return rows.select("answer_id", F.concat(swapped, F.coalesce("behind", F.lit(""))).alias("text"))
