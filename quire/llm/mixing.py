"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within each source; a source's remaining budget is met from these counts alone,
and only then are documents chosen, by a seeded hash, as many of each size as the counts say. So the text is read
once for its size, and what meets in one place is a table of sizes, never the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

#: Documents of one source and size are ranked in groups of about so many.
RANKED = 200
#: The last words of a budget are fitted by dynamic programming over so many words; over more while a sum could be nearer.
FITTED_WORDS = (1 << 15, 1 << 18, 1 << 21)


def n_words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that the words come near the budget, never above it.

    Every size gives its even share, rounded down; then the largest sizes that still fit, until the rest is small;
    then a bounded knapsack over the rest, with documents of all sizes, finds the fullest sum. While a nearer sum is
    possible, more of the shares is given back and the knapsack runs over more words. No sum lies nearer for budgets
    up to the last of FITTED_WORDS, nor where less is left than all sizes' common divisor. Sizes are positive and
    distinct.
    """
    total = int((sizes * counts).sum())
    budget = max(0, min(int(budget), total))
    if budget == total:
        return counts.copy()
    shares = np.minimum(counts, (counts * (budget / total)).astype(np.int64))
    divisor = int(np.gcd.reduce(sizes[counts > 0]))
    best, least = shares, budget + 1
    for width in FITTED_WORDS:
        take = _fitted(sizes, counts, shares, budget, width)
        left = budget - int((sizes * take).sum())
        if left < least:
            best, least = take, left
        if least < divisor or width >= budget:
            break
    return best


def _fitted(sizes: np.ndarray, counts: np.ndarray, shares: np.ndarray, budget: int, width: int) -> np.ndarray:
    """The shares, with their last `width` words fitted to the budget."""
    take = shares.copy()
    rest = budget - int((sizes * take).sum())
    order = np.argsort(-sizes)
    for i in order:
        if rest <= width:
            break
        k = min(int(counts[i] - take[i]), (rest - width // 2) // int(sizes[i]))
        if k > 0:
            take[i] += k
            rest -= k * int(sizes[i])
    # the knapsack may also give back some of what the shares took, so few sizes reach nearly every sum
    back = width - rest
    for i in order:
        k = min(int(take[i]), back // int(sizes[i]))
        if k > 0:
            take[i] -= k
            back -= k * int(sizes[i])
            rest += k * int(sizes[i])
    free = counts - take
    items = [(i, m) for i in order[::-1] if sizes[i] <= rest for m in _binary(min(int(free[i]), rest // int(sizes[i])))]
    reach = np.full(rest + 1, -1, np.int32)  # the item that first reached each sum
    reach[0] = len(items)
    for n, (i, m) in enumerate(items):
        if reach[rest] >= 0:
            break
        w = m * int(sizes[i])
        if w <= rest:
            new = (reach[w:] < 0) & (reach[: rest + 1 - w] >= 0)
            reach[w:][new] = n
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i, m = items[reach[at]]
        take[i] += m
        at -= m * int(sizes[i])
    return take


def _binary(count: int) -> Iterator[int]:
    """Parts of a count from which every number up to it can be summed."""
    part = 1
    while count > 0:
        yield min(part, count)
        count -= part
        part *= 2


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df with `rank`, from 1 in the order of the distinct column `by`, nulls last.

    Rows are dealt by range; a range's ranks begin behind the rows of the ranges before it, of which there are as
    many as partitions.
    """
    order = F.asc_nulls_last(by)
    dealt = save(df.repartitionByRange(order).withColumn("range_id", F.spark_partition_id()), "ranked")
    before = dealt.groupBy("range_id").count().withColumn("before", F.sum("count").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("range_id", F.coalesce("before", F.lit(0)).alias("before"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range_id").orderBy(order)))
    return within.join(F.broadcast(before), "range_id").withColumn("rank", F.col("place") + F.col("before")).drop("range_id", "place", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): share x all words, by weight, no target above most x its source's words.

    sources has (source, source_size). The level of the weights at which all is given out is found by sums over the
    table of sources; each round fixes the sources whose share is above their limit.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = save(ranked(sources, "source").withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, free = 0.0, -1
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        got = weighed.agg(F.sum(F.when(full, limit)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(~full, 1)).alias("free")).first()
        if not got["free"] or got["free"] == free:
            break
        level, free = max(0.0, (share * total - (got["given"] or 0.0)) / got["weight"]), got["free"]
    return weighed.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs, its text left out, with size, source_size, target and taken.

    size: words of the text (null: 0); taken: words that the mix takes of the row, a whole multiple of size and at
    most `most` (rounded down) times it. Sources in order of code points, null last, weigh `weights`, repeating.
    A source without words gets target 0. Rows that repeat are documents of their own. Reruns agree: ties of the
    seeded hash fall to the id, then to the hash of the text. Columns of these names in docs are replaced.
    """
    names = ("size", "source_size", "target", "taken")
    own = docs.drop(*names)
    kept = [c for c in own.columns if c != text_col]
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    # the rows travel as one column, so that no name of theirs meets one of ours
    sized = own.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("mix_key"))
    sized = save(sized, "mix-sizes")
    counts = save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = save(targets(sources, weights, share, most), "mix-targets")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        size = float(group["source_size"].iloc[0])
        target = float(group["target"].iloc[0])
        rounds = int(target // size) if size else 0
        group = group.sort_values("size")
        some = group[group["size"] > 0]
        take = fit_budget(some["size"].to_numpy(np.int64), some["n"].to_numpy(np.int64), round(target - rounds * size)) if len(some) else []
        return some[["source", "size", "n"]].assign(rounds=rounds, more=take)

    # sources are few against documents; their sizes meet in one group each, as many as distinct sizes
    fits = counts.join(goal, counts["source"].eqNullSafe(goal["source"])).select(counts["source"], "size", "n", "source_size", "target")
    plans = save(fits.groupBy("source").applyInPandas(plan, "source string, size long, n long, rounds long, more long"), "mix-plans")
    planned = sized.join(plans.withColumnRenamed("source", "plan_source").withColumnRenamed("size", "plan_size"), F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size")), "left").drop("plan_source", "plan_size")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED))
    planned = planned.withColumn("part", F.floor((F.col("mix_key") / F.lit(2.0**64) + 0.5) * parts))
    in_parts = planned.where("n is not null").groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    ahead = in_parts.withColumn("ahead", F.sum("c").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select(F.col("source").alias("a_source"), F.col("size").alias("a_size"), F.col("part").alias("a_part"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("mix_key", F.col("row")[id_col]))
    picked = (
        planned.join(ahead, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("size") == F.col("a_size")) & (F.col("part") == F.col("a_part")), "left")
        .withColumn("taken", F.col("size") * (F.coalesce("rounds", F.lit(0)) + F.when(place + F.col("ahead") <= F.col("more"), 1).otherwise(0)))
    )
    goal = goal.withColumnRenamed("source", "g_source")
    out = picked.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
