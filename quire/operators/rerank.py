"""Reranking of search results by a pair-scoring function, and what changes by it.

Results are (query_id, rank, id, document, similarity); queries (query_id, text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ScoreFn = Callable[[list[str], list[str]], np.ndarray]


def overlap_score(query: Column, document: Column) -> Column:
    """A stand-in for a model, by columns: the share of the query's distinct words that the text has."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), " "), lambda w: w != ""))
    hit = F.size(F.array_intersect(words, F.array_distinct(F.split(F.lower(document), " "))))
    return F.round(F.when(F.size(words) == 0, 0.0).otherwise(hit / F.size(words)), 6)


def score_pairs(pairs: DataFrame, score_fn: ScoreFn | None = None, batch_size: int = 32) -> DataFrame:
    """pairs with rerank_score of (text, document); score_fn scores batches where the rows are."""
    if score_fn is None:
        return pairs.withColumn("rerank_score", overlap_score(F.col("text"), F.coalesce("document", F.lit(""))))
    pairs = pairs.drop("rerank_score")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, d = b["text"].tolist(), b["document"].fillna("").tolist()
            made = [np.asarray(score_fn(q[a : a + batch_size], d[a : a + batch_size]), float) for a in range(0, len(q), batch_size)]
            yield b.assign(rerank_score=np.concatenate(made) if made else np.zeros(0))

    return pairs.mapInPandas(rows, T.StructType(list(pairs.schema.fields)).add("rerank_score", "double"))


def rerank(results: DataFrame, queries: DataFrame, score_fn: ScoreFn | None = None, top_k: int | None = None) -> DataFrame:
    """Results by score, equal ones as before, with original_score and rank_change (places won); then cut to top_k."""
    scored = score_pairs(results.join(queries.select("query_id", "text"), "query_id"), score_fn)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = scored.withColumns({"new_rank": F.row_number().over(order), "original_score": F.coalesce(*[F.col(c) for c in ("similarity", "distance") if c in results.columns], F.lit(0.0))})
    out = out.withColumn("rank_change", F.col("rank") - F.col("new_rank"))
    return out.where(F.col("new_rank") <= top_k) if top_k else out


def rerank_compare(reranked: DataFrame, k: int = 5) -> DataFrame:
    """The first k before and after, side by side."""
    before = reranked.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("rank_before"))
    after = reranked.where(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank_after"))
    return before.join(after, ["query_id", "id"], "full_outer")


def rerank_movement(reranked: DataFrame) -> DataFrame:
    """Of each query: how many rose, fell, stayed, and the largest move."""
    change = F.col("rank_change")
    return reranked.groupBy("query_id").agg(F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"), F.count_if(change == 0).alias("same"), F.max(F.abs(change)).alias("largest"))


def rerank_top_moves(reranked: DataFrame, k: int = 3) -> DataFrame:
    """Of each query the k that rose most, fell most and gained most in score: (query_id, kind, place, id, amount).

    Only rows that really rose, fell or gained count; equal ones in the order of their former ranks.
    """
    gain = F.round(F.col("rerank_score") - F.col("original_score"), 6)
    kinds = (("riser", F.col("rank_change").cast("double")), ("faller", -F.col("rank_change").cast("double")), ("gain", gain))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), amount.alias("amount")) for name, amount in kinds])).alias("m")
    rows = reranked.select("query_id", "id", "rank", each).select("query_id", "id", "rank", "m.kind", "m.amount").where("amount > 0")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("amount"), "rank")))
    return placed.where(F.col("place") <= k).select("query_id", "kind", "place", "id", "amount")


def rerank_improvement(reranked: DataFrame) -> DataFrame:
    """Mean and best gain in score by query, to six places.

    Scores have six places; they are added up as whole millionths, so that neither the order of a sum nor a tie at
    the seventh place decides. Ties go away from zero.
    """
    units = F.round((F.col("rerank_score") - F.col("original_score")) * 1_000_000).cast("long")
    sums = reranked.groupBy("query_id").agg(F.sum(units).alias("s"), F.count(units).alias("n"), F.max(units).alias("best"))
    mean = F.signum("s") * F.expr("(2 * abs(s) + n) div (2 * n)")
    return sums.select("query_id", (mean / 1_000_000).alias("mean_gain"), (F.col("best") / 1_000_000).alias("best_gain"))


def selective_rerank(reranked: DataFrame, least: float = 0.7, k: int = 5) -> DataFrame:
    """Reranked only where the best similarity is under `least`, else as found; the first k."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    rows = reranked.withColumn("final_rank", F.when(best < least, F.col("new_rank")).otherwise(F.col("rank")))
    return rows.where(F.col("final_rank") <= k)


def subquery_fusion(reranked: DataFrame, groups: DataFrame, per_query: int = 3, k: int = 5) -> DataFrame:
    """Reranked results of the sub-queries of a group in one: the best score by id."""
    top = reranked.where(F.col("new_rank") <= per_query).join(groups, "query_id")
    best = top.groupBy("group_id", "id").agg(F.max("rerank_score").alias("rerank_score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("rerank_score"), "id"))).where(F.col("rank") <= k)


def rerank_dedup(results: DataFrame, queries: DataFrame, score_fn: ScoreFn | None = None) -> DataFrame:
    """Rerank once for each distinct query text: queries of one text share the results of the least id."""
    first = queries.groupBy("text").agg(F.min("query_id").alias("first_id"))
    once = rerank(results.join(first.select(F.col("first_id").alias("query_id")), "query_id", "left_semi"), queries, score_fn)
    return queries.join(first, "text").join(once.withColumnRenamed("query_id", "first_id").drop("text"), "first_id").select("query_id", "id", "rerank_score", "new_rank")
