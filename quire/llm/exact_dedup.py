"""Exact dedup by a content sort, in DataFrame functions only.

The normalised texts are the keys of a sort. Sampled splitters deal their bytes out over ranges: the first bytes and
a hash, so that no whole text goes to the driver as a splitter. Within a range an external sort puts equal texts next
to each other, where the window compares each text with its neighbour in full.

A text of which very many or very long copies exist is hot: its rows are dealt into shares of bounded size, each a run
of its own in the sort. The best row of each share goes on with its text, and shares of equal texts are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

#: Characters of a text that splitters see.
SPLITTER = 32
#: Rows and bytes of copies in one share.
SHARE_ROWS, SHARE_BYTES = 4096, 64 << 20
#: Hot texts at most; in larger tables shares grow, so that the list of hot texts stays small enough to be broadcast.
HOT = 500_000


def normal(text: Column) -> Column:
    """A text without white space; null: empty."""
    out = F.coalesce(text, F.lit(""))
    for sign in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(sign), F.lit(""))
    return out


def hot_texts(keyed: DataFrame, share_rows: int, share_bytes: int) -> DataFrame:
    """(h, shares) of the hashes whose rows take more than one share: at most HOT."""
    known = keyed.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("norm")).alias("bytes")).where("n > 1")
    known = save(known, "text-hashes")
    whole = known.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    rows, size = max(share_rows, 2 * (whole["n"] or 0) // HOT), max(share_bytes, 2 * (whole["bytes"] or 0) // HOT)
    shares = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / size)).cast("int")
    return known.select("h", shares.alias("shares")).where("shares > 1")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share_rows: int = SHARE_ROWS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """One row (id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal if they are the same without white space (space, tab, line feed, vertical tab, form feed, carriage
    return); a null text is an empty one, and empty texts are equal to each other. Of equal texts the row stays whose
    text has the most code points, then the one of the smallest id, a null id last; of rows alike in all of that one
    stays. keep_id is that row's id, group_size counts rows. text_sha256 is that of the normalised text in UTF-8. Very
    long texts are sorted and compared whole. Other columns of docs are left out, whatever their names. An empty
    table gives an empty one.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).alias("n_chars"), normal(F.col(text_col)).alias("norm"))
    keyed = keyed.withColumn("h", F.xxhash64("norm"))
    hot = hot_texts(keyed, share_rows, share_bytes)
    # rows of one id are dealt by where they are read, too: they may be the hot ones
    share = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("shares")).cast("int")
    rows = keyed.join(F.broadcast(hot), "h", "left").withColumns({"start": F.substring("norm", 1, SPLITTER), "share": F.when(F.col("shares").isNotNull(), share).otherwise(0)})
    ranged = rows.repartitionByRange("start", "h", "share")
    run = Window.partitionBy("start", "h", "norm", "share").orderBy(F.desc("n_chars"), F.asc_nulls_last("id"))
    best = lambda c: F.first(c).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(run) == 1
    sorted_ = ranged.withColumns({"first": first, "keep": best("id"), "keep_chars": best("n_chars"), "n": F.count("*").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # a text goes on only from the best row of a share
    text = F.when(F.col("first") & F.col("shares").isNotNull(), F.col("norm")).alias("norm")
    judged = save(sorted_.select("id", "first", "keep", "keep_chars", "n", "h", "share", F.col("shares").isNotNull().alias("hot"), F.sha2("norm", 256).alias("text_sha256"), text), "sorted-texts")
    order = F.struct((-F.col("keep_chars")).alias("chars"), F.col("keep").isNull().alias("none"), F.col("keep"), F.col("share"))
    whole = judged.where("norm is not null").groupBy("h", "norm").agg(F.min(order).alias("best"), F.sum("n").alias("n_all"), F.first("text_sha256").alias("text_sha256"))
    whole = whole.select(F.lit(True).alias("hot"), "text_sha256", F.col("best.keep").alias("keep_all"), F.col("best.share").alias("keep_share"), "n_all")
    # at most as many rows as there are hot texts
    out = judged.drop("norm").join(F.broadcast(whole), ["hot", "text_sha256"], "left")
    kept = F.col("first") & F.when(F.col("hot"), F.col("share") == F.col("keep_share")).otherwise(True)
    keep = F.when(F.col("hot"), F.col("keep_all")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n_all", "n").alias("group_size"), kept.alias("kept"), "text_sha256")
