"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The URLs that rules judge are the labelled ones; from them trees learn what the others look like. URLs are dealt into
folds by a hash; labels count in a URL's suffix statistics only if they are of other folds, so that no feature holds
the label it is to predict. One fold is left out of learning altogether, to measure by, and one to set the threshold
by, where most of its verdicts are right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import save

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: URLs learned from: at most MAX_ROWS, chosen by a hash of the URL.
MAX_ROWS = 20_000
#: Folds of URLs; the first is held out, the threshold is set on the second, the others are learned from.
FOLDS = 5
#: Scores that are tried as threshold.
BINS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_secure", "f_fragment", "f_suffix_pages", "f_suffix_blocked", "f_suffix_known", "f_section_blocked", "f_section_known")


def parts(url: Column) -> dict[str, Column]:
    """host and path. Null or without ://, both are empty; only A-Z of the host are lower-cased."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return {"host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def judged(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> dict[str, Column]:
    """rule and rule_verdict of the longest rule that fits; of equal ones the first. None: null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        of, _, begin = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return {"rule": rule, "rule_verdict": verdict}


def lexical(url: Column) -> dict[str, Column]:
    """Features of a URL by itself; null counts as empty. Needs the columns host and path."""
    u, host, path = F.coalesce(url, F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(u), F.lit(1))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    number = lambda c, sign: (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "f_digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / size,
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0.0).otherwise(number(query, "&") + 1),
        "f_labels": number(host, "."),
        "f_hyphens": number(u, "-"),
        "f_secure": u.startswith("https:").cast("double"),
        "f_fragment": u.contains("#").cast("double"),
    }


@dataclass
class Model:
    """Trees, or the one verdict that all labelled URLs had; from the threshold on a URL is blocked."""

    trees: GBTClassificationModel | None
    constant: float
    threshold: float = 0.5


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def fit(featured: DataFrame, *, max_rows: int = MAX_ROWS, url_col: str = "url", seed: int = 3) -> Model:
    """Learn from at most max_rows of the URLs that rules judge and that are not of the first two folds.

    The threshold is the one that gives the most right verdicts on the second fold, in steps of 1 / BINS.
    """
    label = (F.col("rule_verdict") == "block").cast("double").alias("label")
    ruled = featured.where("rule_verdict is not null")
    known = ruled.where("fold > 1").select(*FEATURES, label, F.xxhash64(url_col).alias("order"))
    sample = save(known.orderBy("order").limit(max_rows).drop("order"), "url-sample").repartition(8)
    found = sample.agg(F.min("label").alias("least"), F.max("label").alias("most")).first()
    if found["least"] is None or found["least"] == found["most"]:
        return Model(None, found["least"] or 0.0)
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, subsamplingRate=0.8, seed=seed)
    made = trees.fit(_assembled(sample))
    second = made.transform(_assembled(ruled.where("fold = 1").select(*FEATURES, label))).select("label", vector_to_array("probability")[1].alias("p"))
    bins = second.groupBy(F.floor(F.col("p") * BINS).cast("int").alias("bin")).agg(F.sum("label").alias("block"), F.sum(1 - F.col("label")).alias("allow")).collect()
    block, allow = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins:
        block[r["bin"]], allow[r["bin"]] = r["block"], r["allow"]
    # right verdicts if the bins from each on are blocked; of several that are best the middle one
    right = np.append(np.cumsum(allow) - allow, allow.sum()) + np.append(np.cumsum(block[::-1])[::-1], 0)
    best = np.flatnonzero(right == right.max())
    return Model(made, 0.0, float(best[len(best) // 2]) / BINS if bins else 0.5)


def features(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """Every row of pages with host, path, rule, rule_verdict, fold and the features.

    A suffix is the last two labels of a host; its statistics are the number of its pages, how many of other folds
    are judged, and the smoothed share of blocks among these, over all pages. A section is the first part of a path,
    with the same statistics. Without any that is judged a share is a half and says nothing; the number tells. Tasks
    add up before the shuffle; the way back is a join whose large partitions are split.
    """
    named = pages.withColumns(parts(F.col(url_col)))
    named = named.withColumns(judged(F.col("host"), F.col("path"), rules))
    named = named.withColumns({"suffix": F.substring_index("host", ".", -2), "fold": F.pmod(F.xxhash64(F.lit(41), url_col), F.lit(FOLDS)).cast("int")})
    named = named.withColumn("section", F.regexp_extract("path", "^/+([^/]*)", 1))
    in_fold = lambda k, said: F.sum(F.when((F.col("fold") == k) & said, 1).otherwise(0))
    known, blocked = F.col("rule_verdict").isNotNull(), F.coalesce(F.col("rule_verdict") == "block", F.lit(False))
    joined = named.withColumns(lexical(F.col(url_col)))
    others = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x) - F.get(name, F.col("fold"))
    for of in ("suffix", "section"):
        stats = named.groupBy(of).agg(F.count("*").alias("n"), F.array(*[in_fold(k, known) for k in range(FOLDS)]).alias("known"), F.array(*[in_fold(k, blocked) for k in range(FOLDS)]).alias("blocked"))
        share = {f"f_{of}_pages": F.log1p("n"), f"f_{of}_blocked": (others("blocked") + 1) / (others("known") + 2), f"f_{of}_known": F.log1p(others("known"))}
        joined = joined.join(stats, of).withColumns(share).drop("n", "known", "blocked")
    return joined.drop("suffix", "section", "f_section_pages")


def ruled(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """Every row of pages with host, path, rule and rule_verdict: what needs no trees. Such columns of pages are replaced."""
    pages = pages.drop("host", "path", "rule", "rule_verdict")
    return pages.withColumns(parts(F.col(url_col))).withColumns(judged(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, max_rows: int = MAX_ROWS, threshold: float | None = None, url_col: str = "url") -> DataFrame:
    """Every row of pages with host, path, rule, verdict, score (the trees' probability of a block) and held_out.

    The verdict is the rule's, without a rule the trees': block from the threshold on, which is the model's own unless
    it is given. If no URL is labelled, or all
    alike, the trees' verdict is that label, without any allow. The trees never saw the labels of held_out rows, a
    fold of the URLs. A null URL has no host, no path and no rule; URLs of any length count whole; rows that repeat
    are judged alike; an empty table gives an empty one. Columns of these names in pages are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score", "held_out")
    # the rows travel as one column, so that no name of theirs meets one of ours
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col(url_col).alias("url"))
    featured = save(features(rows, rules=rules), "url-features")
    model = fit(featured, max_rows=max_rows)
    if model.trees is None:
        scored = featured.withColumn("score", F.lit(model.constant))
    else:
        scored = model.trees.transform(_assembled(featured)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= (model.threshold if threshold is None else threshold), "block").otherwise("allow"))
    return scored.select(*[F.col("row")[c].alias(c) for c in pages.columns], "host", "path", "rule", verdict.alias("verdict"), "score", (F.col("fold") == 0).alias("held_out"))


def brute_rule(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[str, str] | None:
    """The rule that fits best, in plain Python, for tests."""
    best = None
    for said, text in rules:
        of, _, begin = text.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + begin) and (best is None or len(text) > len(best[1])):
            best = said, text
    return best
