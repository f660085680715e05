"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as sequences of words. The neighbourhood of a line are its variants within one deleted word: the
line itself, keyed by each place where a word may be missing, and the line without each of its words, keyed by the
place of that word. Lines whose variants have the same key differ by one word put in, left out or replaced, and all
lines of a key are so near to each other; so the earliest line of a key stands for all its pairs, and a key's lines
are never paired with each other. The words decide in the end.

Most lines have no near line. Two lines of one edit agree in the whole first or the whole second half, so variants
are made only of lines that share a half with another line, and only around the other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

#: Lines of fewer words are compared exactly.
MIN_WORDS = 8
_KEY = ("k1", "k2")


def normal(line: Column) -> Column:
    """A line's words with one space between: what is compared. Without words: empty."""
    odd = line.contains("  ")
    for sign in ("\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(sign)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(29), text)


def _n_words(norm: str) -> Column:
    return F.length(norm) - F.length(F.replace(F.col(norm), F.lit(" "), F.lit(""))) + 1


def keyed_lines(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, line_no, k1, k2, h0..h3): every line with words of every text, by hashes. Null text: none.

    k1 and k2 are the line's, h0 and h1 those of its first and second half, h2 and h3 of the halves of a line of one
    word less, of which it may be a longer one; null where no near line can share them.
    """
    split = F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")
    every = docs.select(F.col(id_col).alias("id"), _text_key(F.col(text_col)).alias("text_key"), split)
    every = every.select("id", "text_key", "line_no", normal(F.col("line")).alias("norm")).where("norm <> ''").withColumn("n", _n_words("norm"))
    half = lambda m, side, count, enough: F.when(enough, F.xxhash64(m, F.lit(side), F.call_function("substring_index", F.col("norm"), F.lit(" "), count)))
    n, n_less = F.col("n"), F.col("n") - 1
    first = lambda m: (F.floor(m / 2)).cast("int")
    halves = {
        "h0": half(n, 0, first(n), n >= least),
        "h1": half(n, 1, -(n - first(n)).cast("int"), n >= least),
        "h2": half(n_less, 0, first(n_less), n > least),
        "h3": half(n_less, 1, -(n_less - first(n_less)).cast("int"), n > least),
    }
    return every.select("id", "text_key", "line_no", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(7), "norm", F.length("norm")).alias("k2"), *[c.alias(name) for name, c in halves.items()])


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("line_no"))


def distinct_lines(every: DataFrame) -> DataFrame:
    """(k1, k2, first, first_text, copies, h0..h3) of every distinct line; `first` is its earliest place, first_text the key of the text if that has no id."""
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("line_no"), F.when(F.col("id").isNull(), F.col("text_key")).alias("text"))
    found = every.groupBy(*_KEY).agg(F.min(place).alias("f"), F.count("*").alias("copies"), *[F.max(f"h{s}").alias(f"h{s}") for s in range(4)])
    return found.select(*_KEY, F.struct("f.none", "f.id", "f.line_no").alias("first"), F.col("f.text").alias("first_text"), "copies", *[f"h{s}" for s in range(4)])


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, partner): distinct lines within one word of an earlier one, with the earliest such line's place."""
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"h{s}").alias("half")) for s in range(4)])).alias("h")
    halves = distinct.select(*_KEY, slots).where("h.half is not null").select(*_KEY, "h.slot", "h.half")
    shared = halves.groupBy("half").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least <> most").select("half")
    flags = halves.join(shared, "half").groupBy(*_KEY).agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("slots"))
    flags = flags.select(*_KEY, *[F.getbit("slots", F.lit(s)).cast("int").alias(f"s{s}") for s in range(4)])
    # the words of the lines that may have a near one, from the document where they stand first
    chosen = flags.join(distinct.select(*_KEY, "first", "first_text"), list(_KEY))
    # by id, or without one by text: many rows may have none
    wanted = chosen.groupBy(F.col("first.id").alias("first_id"), "first_text").agg(F.collect_list(F.struct(*_KEY, "s0", "s1", "s2", "s3", "first")).alias("wanted"))
    there = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & F.when(F.col("id").isNull(), _text_key(F.col("text"))).eqNullSafe(F.col("first_text")))
    there = there.withColumn("all_lines", F.split("text", "\n"))
    there = there.select(F.explode(F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get("all_lines", w["first"]["line_no"]).alias("line")))).alias("x"))
    chosen = there.select("x.w.*", normal(F.col("x.line")).alias("norm")).where(F.xxhash64("norm") == F.col("k1")).dropDuplicates(list(_KEY))
    chosen = save(chosen, "line-candidates")

    # a line is split once; only the number of its words goes with each of them
    split = chosen.select(*_KEY, "first", "s0", "s1", "s2", "s3", F.split("norm", " ").alias("words")).withColumn("n", F.size("words"))
    words = split.select(*_KEY, "first", "s0", "s1", "s2", "s3", "n", F.posexplode("words").alias("pos", "word"))
    value = lambda place: F.shiftrightunsigned(F.xxhash64("word", place), 30)
    words = words.withColumns({"i": F.col("pos") + 1, "left": value(F.col("pos")), "right": value(F.col("pos") - F.col("n"))})
    line = Window.partitionBy(*_KEY).orderBy("i")
    sums = words.withColumns({"upto": F.sum("left").over(line.rowsBetween(Window.unboundedPreceding, 0)), "behind": F.sum("right").over(Window.partitionBy(*_KEY).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))})
    before, after = F.col("upto") - F.col("left"), F.col("behind") - F.col("right")
    longer = lambda m, i: F.expr(f"(s0 = 1 and {i} > {m} div 2) or (s1 = 1 and {i} <= {m} div 2)")
    shorter = F.expr("(s2 = 1 and i > (n - 1) div 2) or (s3 = 1 and i <= (n - 1) div 2)")
    # key: words of the variant, place of the gap, what stands before it, what behind
    without = F.when(longer("n", "i") | shorter, F.struct((F.col("n") - 1).alias("m"), F.col("i").alias("gap"), F.xxhash64(F.col("n") - 1, "i", before, after).alias("variant")))
    whole = F.when(longer("n", "i"), F.struct(F.col("n").alias("m"), F.col("i").alias("gap"), F.xxhash64("n", "i", before, F.col("behind")).alias("variant")))
    end = F.when((F.col("i") == F.col("n")) & longer("n", "n + 1"), F.struct(F.col("n").alias("m"), (F.col("n") + 1).alias("gap"), F.xxhash64("n", F.col("n") + 1, "upto", F.lit(0).cast("long")).alias("variant")))
    variants = sums.select(*_KEY, "first", F.explode(F.filter(F.array(without, whole, end), lambda x: x.isNotNull())).alias("v")).select(*_KEY, "first", "v.*")
    variants = save(variants, "line-variants")  # read twice below: for the earliest of each key and for the way back
    earliest = variants.groupBy("variant").agg(F.min(F.struct("first", *_KEY)).alias("e"), F.count("*").alias("c")).where("c > 1").select("variant", F.col("e.first").alias("partner"), F.col("e.k1").alias("p1"), F.col("e.k2").alias("p2"))
    pairs = variants.join(earliest, "variant").where("partner < first").groupBy(*_KEY, "p1", "p2", "partner").agg(F.min(F.struct("m", "gap")).alias("at"))
    # the words themselves decide: the same before the gap and the same behind it
    own = chosen.select(*_KEY, F.split("norm", " ").alias("a"))
    other = chosen.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.split("norm", " ").alias("b"))
    checked = pairs.join(own, list(_KEY)).join(other, ["p1", "p2"])
    front = lambda x: F.expr(f"slice({x}, 1, at.gap - 1)")
    back = lambda x: F.expr(f"slice({x}, size({x}) - (at.m - at.gap + 1) + 1, at.m - at.gap + 1)")
    within = F.expr("size(a) - at.m between 0 and 1 and size(b) - at.m between 0 and 1") & (front("a") == front("b")) & (back("a") == back("b"))
    return checked.where(within).groupBy(*_KEY).agg(F.min("partner").alias("partner"))


def judged_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, flags): for each text, by line, 0 keep, 1 an earlier line is the same, 2 one is near.

    Texts without a line that goes are left out.
    """
    every = save(keyed_lines(docs, min_words, id_col, text_col), "keyed-lines")
    distinct = save(distinct_lines(every), "distinct-lines")
    near = save(near_lines(docs, distinct, id_col, text_col), "near-lines")
    known = distinct.select(*_KEY, "first", "copies").join(near, list(_KEY), "left").where("copies > 1 or partner is not null").select(*_KEY, "first", F.col("partner").isNotNull().alias("near"))
    # a line's place is put together behind the join, so that its id moves once
    found = every.select("id", "text_key", "line_no", *_KEY).join(known, list(_KEY))
    goes = F.when(F.col("first") < _place(), 1).when(F.col("near"), 2)
    return found.select("id", "text_key", "line_no", goes.alias("goes")).where("goes is not null").groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("line_no", "goes"))).alias("gone"))


def line_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs, its text without the lines that go, with n_lines, n_exact, n_near (int).

    A line goes if an earlier line, by id and then by its number, has the same words (n_exact), or, both having
    `min_words` words or more, differs from it by one word put in, left out or replaced (n_near). Lines are judged
    on the input, not on what is left. Lines without words never go. Null text: no lines, stays null. Rows with the
    same id are equally early: neither takes the other's lines. A null id comes last. Columns of these names in docs
    are replaced.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near")
    gone = judged_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col).withColumnsRenamed({"id": "gone_id", "text_key": "gone_key"})
    # the rows travel as one column beside their text, so that no name of theirs meets one of ours
    own = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (_text_key(F.col("text")) == F.col("gone_key")), "left")
    # the kept lines lie between the numbers that go, which are in order
    edges = F.concat(F.array(F.lit(-1)), F.transform("gone", lambda g: g["line_no"]), F.array(F.size("all_lines")))
    runs = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.slice("all_lines", F.element_at("edges", i) + 2, F.element_at("edges", i + 1) - F.element_at("edges", i) - 1))
    count = lambda kind: F.coalesce(F.size(F.filter("gone", lambda g: g["goes"] == kind)), F.lit(0))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = joined.withColumn("all_lines", F.split("text", "\n")).withColumn("edges", edges)
    counts = {"n_lines": F.greatest(F.size("all_lines"), F.lit(0)), "n_exact": F.when(F.col("gone").isNull(), 0).otherwise(count(1)), "n_near": F.when(F.col("gone").isNull(), 0).otherwise(count(2))}
    return out.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])
