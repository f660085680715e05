"""Processing times of pages: adaptive limits and statistics. Rows are (document_id, page_number, elapsed).

A document may have any number of pages. What runs over its pages in order is computed in two levels: within ranges
of RANGE page numbers, each a group of its own in the one shuffle of the pages, and over the ranges, of which only a
row each moves. No task holds more than a range's pages in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds for a first page, factor over the slowest page before, least limit. Fixed values.
FIRST_LIMIT, FACTOR, LEAST_LIMIT = 180.0, 3.0, 10.0
#: Page numbers of one range.
RANGE = 4096
_KEY = ("document_id", "page_range")


def _ranged(pages: DataFrame, size: int) -> DataFrame:
    return pages.withColumn("page_range", F.floor(F.col("page_number") / size))


def _before(ranges: DataFrame, **columns: Column) -> DataFrame:
    """Ranges with what the ranges before them in their document add up to."""
    order = Window.partitionBy("document_id").orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*_KEY, *[c.over(order).alias(name) for name, c in columns.items()])


def adaptive_timeout(pages: DataFrame, least: float = LEAST_LIMIT, size: int = RANGE) -> DataFrame:
    """Pages up to the first that breaks its limit; a limit follows from the pages before."""
    rows = _ranged(pages, size)
    within = Window.partitionBy(*_KEY).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    ranges = _before(rows.groupBy(*_KEY).agg(F.max("elapsed").alias("slowest")), slower=F.max("slowest"))
    before = F.greatest("slower", F.max("elapsed").over(within))  # nulls don't count
    limits = rows.join(ranges, list(_KEY)).withColumn("before", before)
    limits = limits.withColumn("limit_s", F.when(F.col("before").isNull(), FIRST_LIMIT).otherwise(F.greatest(F.lit(least), F.col("before") * FACTOR)))
    limits = limits.withColumn("breach", F.col("elapsed") > F.col("limit_s")).drop("slower", "before")
    # the first breach of a document, told to each of its ranges
    first = limits.where("breach").groupBy("document_id").agg(F.min("page_number").alias("first_breach"))
    told = ranges.select(*_KEY).join(first, "document_id")
    out = limits.join(told, list(_KEY), "left").where("first_breach is null or page_number <= first_breach")
    return out.drop("first_breach", "page_range")


def page_time_stats(pages: DataFrame, every: int = 10, size: int = RANGE) -> DataFrame:
    """Running statistics at each tenth page and the last, with the progress in per cent."""
    rows = _ranged(pages, size)
    sums = rows.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count("elapsed").alias("timed"), F.sum("elapsed").alias("s"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"))
    totals = sums.groupBy("document_id").agg(F.sum("n").alias("n_pages"))
    ranges = _before(sums, idx_0=F.sum("n"), timed_0=F.sum("timed"), s_0=F.sum("s"), least_0=F.min("least"), most_0=F.max("most")).join(totals, "document_id")
    order = Window.partitionBy(*_KEY).orderBy("page_number")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    none = lambda c: F.coalesce(c, F.lit(0))
    own = rows.withColumns({"idx": F.row_number().over(order), "timed": F.count("elapsed").over(upto), "s": F.sum("elapsed").over(upto), "least": F.min("elapsed").over(upto), "most": F.max("elapsed").over(upto)})
    joined = own.join(ranges, list(_KEY)).withColumn("idx", (F.col("idx") + none(F.col("idx_0"))).cast("int")).where(f"idx % {every} = 0 or idx = n_pages")
    timed = F.col("timed") + none(F.col("timed_0"))
    total = F.when(timed > 0, none(F.col("s")) + none(F.col("s_0")))
    others = [c for c in pages.columns if c != "elapsed"]
    stats = {"idx": F.col("idx"), "n_pages": F.col("n_pages"), "avg_s": total / timed, "min_s": F.least("least", "least_0"), "max_s": F.greatest("most", "most_0"), "total_s": total}
    return joined.select(*others, *[c.alias(name) for name, c in stats.items()]).withColumn("progress", F.floor(F.col("idx") * 100 / F.col("n_pages")).cast("int"))
