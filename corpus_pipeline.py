"""The corpus pipeline: five stages over documents, each of them one operator.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of documents.

Alike in every stage: an empty table gives an empty one; repeated rows are rows of their own unless a stage drops
them; columns besides doc_id, text, source and n_chars travel along, whatever their names; texts of any length are
judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, line_dedup, minhash, mixing, toxicity
from quire.llm.common import save, table

#: Percent of shingles that near-duplicate documents share.
NEAR_PER_CENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. A null or empty text has the score of the bias alone, a null
    id counts as not held out; without labels nothing is rejected."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; a document of which no word is left goes.

    n_chars follows the text where lines went. Null and empty texts have no lines and stay; of rows of one id none
    takes the other's lines; a null id comes last.
    """
    done = line_dedup.line_dedup(docs)
    empty = ((F.col("n_exact") + F.col("n_near")) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when((F.col("n_exact") + F.col("n_near")) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(~empty).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates.

    Null texts and texts without words are linked with nothing and stay, as do rows with a null id. Rows of one id
    are one document: all stay or all go.
    """
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), per_cent=NEAR_PER_CENT)
    return docs.join(judged.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items. Null and empty texts stay; so does all without a benchmark."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the mix: the documents taken, and how many words of each, repeats counted.

    Documents without words (null and empty texts) are never taken; a null source is one of its own, the last; ties
    of the seeded hash fall to the id.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicate documents", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the learned, hashed and seeded stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
