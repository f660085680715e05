"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space, of any alphabet, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def slug(c: Column, fallback: Column, limit: int | None = None) -> Column:
    """A file name: white space to underscores, other signs than letters, digits, dot and dash dropped."""
    kept = F.regexp_replace(F.regexp_replace(strip(c), r"\s+", "_"), r"[^A-Za-z0-9._-]", "")
    kept = F.left(kept, F.lit(limit)) if limit else kept
    return F.when(kept == "", fallback).otherwise(kept)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit("...")))


def word_count(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def occurrences(c: Column, word: Column) -> Column:
    """Times that a word occurs in a text, without overlap."""
    return F.when(F.length(word) == 0, 0).otherwise(((F.length(c) - F.length(F.replace(c, word, F.lit("")))) / F.length(word)).cast("int"))


def ordered_join(key: Column, value: Column, sep: str) -> Column:
    """An aggregate: values joined in the order of a struct of keys."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]), sep)
