"""Phrase collocations: n-grams counted out of core by hash bucket, scored from the counts of their parts.

Texts are cut into pieces at punctuation and line ends. Most text that repeats does so in whole pieces, so identical
pieces are put together first, with a multiplicity, and only distinct pieces are taken apart into n-grams, each of
its piece's weight. A task adds up its n-grams and hands them on in buckets of their hash, as compressed lines; each
bucket is added up by duckdb in bounded memory, in the task's own folder beyond that. A hot n-gram thus reaches its
bucket at most once from each block of a task.

A phrase asks for the counts of its parts: the requests are shuffled to where the parts' counts are. Large partitions
of that join, as those of a very frequent word, are split.

n-grams travel as UTF-8 with a space between words.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import mix, partitions, save

#: Words of a phrase at most, occurrences at least, phrases of a language in the result.
MAX_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
#: A phrase is dropped if a longer one that holds it has this share of its occurrences, in per cent.
WITHIN = 50
#: A language of texts without one.
NO_LANG = "und"
#: Bytes of distinct pieces after which a task hands on its counts; bytes of pieces taken apart at once.
PIECES_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Words of one bucket, each the start of MAX_WORDS n-grams.
BUCKET_WORDS = 1_000_000
#: Memory of duckdb in one task; beyond that it writes to the task's folder.
MEMORY = "192MB"
#: A-Z in lower case, every piece's end as a line feed, tabs as spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Buckets at most; in larger tables duckdb writes more of each to disk.
MOST_BUCKETS = 1 << 15
#: Rows that duckdb gets at once.
ROWS = 200_000
_NEXT = np.uint64(0x9E3779B97F4A7C15)


# ----------------------------------------------------------------- pieces


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, times) of every distinct piece with words: its words with one space between, in UTF-8."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                worded = [b" ".join(p.split()) for p in counts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(worded), pa.string()), pa.array(worded, pa.binary()), pa.array(counts.values(), pa.int64())], ["lang", "piece", "times"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                if not text.is_valid:
                    continue
                data = text.as_buffer().to_pybytes().translate(_TABLE)
                seen.setdefault(lang.as_py(), Counter()).update(data.split(b"\n"))
                size += len(data)
                if size > PIECES_BYTES:  # copies don't count twice
                    size = sum(len(p) for counts in seen.values() for p in counts)
                    if 2 * size > PIECES_BYTES:
                        yield from told()
                        size = 0
        yield from told()

    rows = docs.select(F.coalesce(lang_col, F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    some = rows.mapInArrow(partial, "lang string, piece binary, times long").where(F.octet_length("piece") > 0)
    return some.groupBy("lang", "piece").agg(F.sum("times").alias("times"))


# ----------------------------------------------------------------- n-grams of a block of pieces


def stretches(piece: bytes, spare: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """A long piece in stretches of about `limit` bytes, each with the number of its last words at which none of its
    n-grams begins: the next stretch begins with them."""
    at = 0
    while len(piece) - at > limit:
        back = end = piece.rfind(b" ", at, at + limit)
        for _ in range(spare):
            back = piece.rfind(b" ", at, max(at, back))
        if back <= at:  # words of about the limit's size
            break
        yield piece[at:end], spare
        at = back + 1
    yield piece[at:], 0


def n_grams(held: list[bytes], times: np.ndarray, tails: np.ndarray, max_words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(lines, totals, hashes) of the distinct n-grams of some pieces, for each number of words in turn.

    Words are numbered in order; an n-gram of k words is the number of its first k - 1 and that of its last, which is
    numbered again in the same way. So nothing but these numbers is sorted, and nothing collides.
    """
    data = np.frombuffer(bytearray(b"\n".join(held) + b"\n"), np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    last = data[ends] == 10
    data[ends] = 32
    n = len(ends)
    offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    known = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[coded.indices.to_numpy()]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known.to_pylist()], np.uint64)
    piece = np.cumsum(last) - last
    end = (np.flatnonzero(last) + 1)[piece]
    weight = times[piece]
    left = end - np.arange(n)  # words up to the piece's end
    begins = left > tails[piece]
    number = ids
    for k in range(1, max_words + 1):
        at = np.flatnonzero(begins & (left >= k))
        if not len(at):
            break
        key = number[at] * len(known) + ids[at + k - 1] if k > 1 else ids[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.zeros(n, np.int64)
        number[at] = np.cumsum(new) - 1
        totals = np.add.reduceat(weight[at], np.flatnonzero(new))
        first = at[new]
        code = np.full(len(first), np.uint64(k))
        for j in range(k):
            code = mix(code * _NEXT + hashes[ids[first + j]])
        yield pc.binary_join_element_wise(*[known.take(pa.array(ids[first + j])) for j in range(k)], b""), totals, code


def _bucketed(lang: str, held: list[bytes], times: list[int], tails: list[int], max_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, lang, lines, totals): the n-grams of some pieces in compressed lines, in order within a bucket."""
    press = zstandard.ZstdCompressor(level=3)
    for lines, totals, codes in n_grams(held, np.array(times, np.int64), np.array(tails, np.int64), max_words):
        bucket = (codes % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, totals, lines = bucket[order], totals[order], lines.take(pa.array(order))
        offsets = np.frombuffer(lines.buffers()[1], np.int32)[: len(lines) + 1]
        data = np.frombuffer(lines.buffers()[2], np.uint8).copy()
        del lines
        data[offsets[1:] - 1] = 10
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for a, b in zip(edges, edges[1:]):
            told = [press.compress(data[offsets[a] : offsets[b]].tobytes()), press.compress(totals[a:b].tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([lang], pa.string()), *[pa.array([x], pa.binary()) for x in told]], ["bucket", "lang", "lines", "totals"])
    pa.default_memory_pool().release_unused()


# ----------------------------------------------------------------- counts by bucket


class _Bucket:
    """The n-grams of one bucket, added up by duckdb; what exceeds its memory goes to a folder that is removed at the end."""

    def __init__(self, least: int):
        self.least, self.folder, self.waiting, self.rows = least, tempfile.TemporaryDirectory(), [], 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name})
        self.db.execute("CREATE TABLE part (lang VARCHAR, gram BLOB, n BIGINT)").fetchall()

    def put(self, lang: str, lines: bytes, totals: bytes) -> None:
        open_ = zstandard.ZstdDecompressor()
        data, n = open_.decompress(lines), np.frombuffer(open_.decompress(totals), np.int64)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        gram = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        self.waiting.append(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "gram": gram, "n": n}))
        self.rows += len(n)
        if self.rows >= ROWS:
            self.send()

    def send(self) -> None:
        if self.waiting:
            self.db.register("waiting", pa.concat_tables(self.waiting))
            self.db.execute("INSERT INTO part SELECT lang, gram, n FROM waiting").fetchall()
            self.db.unregister("waiting")
        self.waiting, self.rows = [], 0

    def done(self) -> list[pa.RecordBatch]:
        """Those of `least` occurrences or more; without their line feeds."""
        self.send()
        added = f"SELECT lang, gram[:-2] AS gram, sum(n) :: BIGINT AS n FROM part GROUP BY lang, part.gram HAVING sum(n) >= {int(self.least)}"
        out = self.db.sql(added).to_arrow_table().to_batches(max_chunksize=10_000)
        self.db.close()
        self.folder.cleanup()
        pa.default_memory_pool().release_unused()
        return out


def n_gram_counts(distinct: DataFrame, max_words: int, least: int, buckets: int) -> DataFrame:
    """(lang, gram, n) of every n-gram of up to max_words words that occurs `least` times or more in (lang, piece, times)."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list, list]] = {}
        sizes: Counter = Counter()
        for batch in batches:
            for lang, piece, times in zip(batch.column("lang").to_pylist(), batch.column("piece").to_pylist(), batch.column("times").to_pylist()):
                for stretch, tail in stretches(piece, max_words - 1, BLOCK_BYTES):
                    for own, x in zip(held.setdefault(lang, ([], [], [])), (stretch, times, tail)):
                        own.append(x)
                    sizes[lang] += len(stretch) + 1
                    if sizes.total() > BLOCK_BYTES:  # the language of which most is held
                        most = max(sizes, key=sizes.get)
                        sizes.pop(most)
                        yield from _bucketed(most, *held.pop(most), max_words, buckets)
        for lang, own in held.items():
            yield from _bucketed(lang, *own, max_words, buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, lang, lines, totals = (column[k].as_py() for column in batch.columns)
                if bucket != now:
                    if sums:
                        yield from sums.done()
                    now, sums = bucket, _Bucket(least)
                sums.put(lang, lines, totals)
        if sums:
            yield from sums.done()

    parts = distinct.mapInArrow(apart, "bucket int, lang string, lines binary, totals binary")
    dealt = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "lang string, gram binary, n long").select("lang", F.col("gram").cast("string").alias("phrase"), "n")


# ----------------------------------------------------------------- phrases


def _n_words(phrase: str):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def _scores(batches: Iterator[pa.RecordBatch], cuts: int) -> Iterator[pa.RecordBatch]:
    """The cut of the least score of each phrase; Python's integers are as long as products need."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            a = row["a"]
            sides = [(row[f"l{k}"], row[f"r{k}"]) for k in range(1, cuts + 1) if row[f"l{k}"] is not None]
            score, cut = min((1_000_000 * a * a // (x * y), k) for k, (x, y) in enumerate(sides))
            out.append((score, *sides[cut]))
        score, left, right = ([x[k] for x in out] for k in range(3))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), batch.column("a"), *[pa.array(x, pa.int64()) for x in (left, right, score)]], ["lang", "phrase", "a", "l", "r", "score"])


def scored(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more among (lang, phrase, n)."""
    phrases = counts.withColumn("size", _n_words("phrase")).where("size > 1").withColumnRenamed("n", "a")
    side = lambda cut, right: F.struct(F.lit(cut).alias("cut"), F.lit(right).alias("right"), F.call_function("substring_index", F.col("phrase"), F.lit(" "), (F.lit(cut) - F.col("size")) if right else F.lit(cut)).alias("part"))
    asked = F.filter(F.array(*[side(cut, right) for cut in range(1, max_words) for right in (False, True)]), lambda x: x["cut"] < F.col("size"))
    requests = phrases.select("lang", "phrase", "a", F.explode(asked).alias("ask")).select("lang", "phrase", "a", "ask.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    sides = {f"{'r' if right else 'l'}{cut}": F.max(F.when((F.col("cut") == cut) & (F.col("right") == right), F.col("n"))) for cut in range(1, max_words) for right in (False, True)}
    found = answers.groupBy("lang", "phrase", "a").agg(*[c.alias(name) for name, c in sides.items()])
    return found.mapInArrow(lambda batches: _scores(batches, max_words - 1), "lang string, phrase string, a long, l long, r long, score long")


def held_within(counts: DataFrame, max_words: int, within: int) -> DataFrame:
    """(lang, phrase) of the phrases that a longer one holds which has `within` per cent of their occurrences."""
    phrases = counts.withColumn("size", _n_words("phrase")).where("size > 1")
    words = F.split("phrase", " ")
    shorter = [F.array_join(F.slice(words, at, size), " ") for size in range(2, max_words) for at in range(1, max_words - size + 2)]
    every = [(size, at) for size in range(2, max_words) for at in range(1, max_words - size + 2)]
    inner = F.array(*[F.when((F.col("size") > size) & (F.col("size") >= at + size - 1), part) for (size, at), part in zip(every, shorter)])
    most = phrases.select("lang", F.explode(F.filter(inner, lambda x: x.isNotNull())).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # in decimals: a hundred times a count may pass 64 bits
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return phrases.join(most, ["lang", "phrase"]).where(wide("longer") * 100 >= wide("n") * within).select("lang", "phrase")


def collocations(docs: DataFrame, *, max_words: int = MAX_WORDS, least: int = LEAST_COUNT, top: int = TOP, within: int = WITHIN, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    A-Z count as a-z. Pieces end at . , ; : ! ? and at line feeds, vertical tabs, form feeds and carriage returns;
    words are runs of what is neither space nor tab. A phrase has two to max_words words within a piece and occurs
    `least` times or more, overlaps included (a). Of the cuts of a phrase into two parts, which occur l and r times,
    the one of the least floor(1000000 a a / (l r)) counts, of several the one of the fewest words on the left; that
    is its score. Phrases whose words lie within a longer phrase with `within` per cent of their occurrences are left
    out. n is the number of words of the language. Order: score, then a, both descending, then the phrase's bytes.

    A null language is `und` and one with the language of that name. Null and empty texts have no pieces; repeated
    rows count each. Texts and pieces of any length are counted whole. Other columns of docs don't matter, whatever
    their names. An empty table gives an empty one.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    distinct = save(pieces(docs, lang_col, text_col), "phrase-pieces")
    words = distinct.select("lang", F.col("piece").cast("string").alias("piece"), "times").select("lang", (_n_words("piece") * F.col("times")).alias("n"), _n_words("piece").alias("own"))
    sizes = save(words.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "phrase-sizes")
    own = sizes.agg(F.sum("own").alias("own")).first()["own"] or 0
    buckets = min(MOST_BUCKETS, max(partitions(docs.sparkSession), own // BUCKET_WORDS + 1))
    counts = save(n_gram_counts(distinct, max_words, least, buckets), "phrase-counts")
    kept = scored(counts, max_words).join(held_within(counts, max_words, within), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
