"""Token counts of whole documents without making the tokens.

The piece model merges characters into pieces; no merge crosses the edge of a pre-token. So the corpus is cut into
pre-tokens, each distinct pre-token is encoded once, and a document's count is the sum over its pre-token
frequencies. The head of the vocabulary (a fixed number of bounded strings) is broadcast and summed where the text
is read; the tail meets its counts in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import save

#: Bound of the broadcast dictionary: so many pre-tokens, none longer than so many characters (about 20 MB at most).
HEAD_SIZE, HEAD_CHARS = 120_000, 48
#: A task hands over its partial vocabulary when it has so many entries.
FLUSH = 200_000
_MARK = "▁"


@lru_cache(maxsize=4)
def load(model_path: str):
    """(processor, pattern of pre-tokens) of a piece model with byte fallback.

    Two neighbours that no piece holds side by side are never merged. So a character that occurs in no piece of two
    or more characters is a pre-token by itself; a run of the marks of spaces, which in all pieces stand in front
    only, begins a pre-token; and so does a run of those signs that no piece has behind a character of another kind.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    several = [p for p in pieces if len(p) > 1]
    if any(_MARK in p.lstrip(_MARK) for p in several) or any("\n" in p for p in several):
        raise ValueError("this model has pieces that cross pre-tokens")
    merged = set("".join(several)) - {_MARK}
    pairs = {x + y for p in several for x, y in zip(p, p[1:]) if x != _MARK}
    signs = {c for c in merged if not c.isalnum()}
    while behind := {y for x, y in pairs if y in signs and x not in signs}:
        signs -= behind
    one_of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
    sign, other = one_of(signs), one_of(merged - signs)
    return model, re.compile(f"{_MARK}+{sign}*{other}*|{sign}+{other}*|{other}+|[^{_MARK}]")


def pre_tokens(text: str | None, pattern: re.Pattern) -> list[str]:
    """Pre-tokens of a text as the model sees it: spaces marked, one mark in front. Null or empty: none."""
    return pattern.findall(_MARK + text.replace(" ", _MARK)) if text else []


def count_pieces(tokens: list[str], model) -> list[int]:
    """Pieces of each pre-token. A line break in front takes the mark that the library puts before a text."""
    alone = len(model.encode("\n"))
    return [len(x) - alone for x in model.encode(["\n" + t for t in tokens], num_threads=1)]


def vocabulary(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(token, freq, pieces) of every distinct pre-token of all texts; tasks add up before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern = load(model_path)
        seen: Counter = Counter()
        # typed and cut, so that a task without rows and one with very many tokens alike hand over whole batches
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py(), pattern))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, _ = load(model_path)
        for batch in batches:
            yield batch.assign(pieces=count_pieces(list(batch["token"]), model))

    counted = docs.select(text_col).mapInArrow(partial, "token string, n long").groupBy("token").agg(F.sum("n").alias("freq"))
    return counted.mapInPandas(encode, "token string, freq long, pieces long")


def token_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", head_size: int = HEAD_SIZE) -> DataFrame:
    """Every row of docs with n_bytes (UTF-8) and n_tokens, both long.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows stay, each with its counts. An empty table gives an empty
    one. Columns of docs named n_bytes or n_tokens are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_tokens")
    known = save(vocabulary(docs, model_path, text_col), "token-vocabulary")
    short = known.where(F.length("token") <= HEAD_CHARS)
    # from which frequency on there are few enough tokens: a sum over the few distinct frequencies of frequent ones
    at_least = short.groupBy(F.least("freq", F.lit(1 << 20)).alias("f")).count().withColumn("n", F.sum("count").over(Window.orderBy(F.desc("f")))).where(F.col("n") <= head_size)
    least = at_least.agg(F.min("f").alias("f")).first()["f"]
    top = short.where(F.col("freq") >= (least or 1 << 62)).select("token", "pieces").toPandas()
    head = spark.sparkContext.broadcast(dict(zip(top["token"], top["pieces"].astype(int))))
    others = [c for c in docs.columns if c != text_col]
    # the other columns travel as one, so that no name of theirs meets one of ours
    rows = docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("n_bytes", "long").add("head_tokens", "long")
    schema = schema.add("tail", T.ArrayType(T.StructType().add("token", "string").add("n", "long")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern = load(model_path)
        pieces = head.value
        for batch in batches:
            n_bytes, sums, ends, tokens, times = [], [], [0], [], []
            for text in batch.column("text").to_pylist():
                total, tail = 0, Counter()
                for token in pre_tokens(text, pattern):
                    k = pieces.get(token)
                    if k is None:
                        tail[token] += 1
                    else:
                        total += k
                n_bytes.append(len(text.encode()) if text else 0)
                sums.append(total)
                tokens += tail.keys()
                times += tail.values()
                ends.append(len(tokens))
            pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], ["token", "n"])
            out = [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(out, ["row", "n_bytes", "head_tokens", "tail"])

    counted = rows.mapInArrow(count, schema)
    counted = save(counted.withColumn("row_key", F.monotonically_increasing_id()), "token-counts")
    rest = (
        counted.select("row_key", F.explode("tail").alias("t"))
        .select("row_key", "t.token", "t.n")
        .join(known.select("token", "pieces"), "token")
        .groupBy("row_key")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("tail_tokens"))
    )
    return counted.join(rest, "row_key", "left").select(*[F.col("row")[c].alias(c) for c in others], "n_bytes", (F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))).alias("n_tokens"))
