"""Benchmark decontamination: passages of documents within an edit distance of benchmark items.

Texts are sequences of words. A random walk (CGK) embeds a sequence so that few edits become few differing
coordinates; a key is made of coordinates sampled from one walk, and a window of a text and an item with an equal key
are candidates. The walk over a window of an item's size begins at every word of a text, and, backwards, ends at every
word; the exact edit distance decides on what the keys bring together.

Coordinates are sampled early in a walk, before many edits have put two walks out of step. Edits may lie anywhere in a
passage, also all at its ends; so walks begin at anchors all over an item, some forwards, some backwards, and wherever
the allowed edits lie, some stretch has few. A key says at which word of its item it began, and so where the item's
window lies. Walks repeat until the keys of a passage at the bound of edits meet with the recall that RECALL states,
for the worst placing of the edits that tests know. Of the windows that keys find, those that lack more of the item's
words than edits are allowed are left out before the exact distance is computed.

The benchmark is the query set. It is broadcast in blocks of bounded size, each held against all documents where
they are read; documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bound_batches, mix, save, string_slices, words

#: A passage matches within this share of the item's words as edits (rounded down).
EDITS = 0.2
#: Items of fewer words are not looked for: they allow no edit and stand in ordinary speech.
LEAST_WORDS = 5
#: Walks in each direction, coordinates of a key, steps from which they are sampled at most.
WALKS, SAMPLED, REACH = 6, 4, 12
#: Walks begin at every so manieth word of an item: no multiple of five, so that edits at every fifth word leave some out.
STRIDE = 3
#: Share of the passages at the bound of edits, of any size from LEAST_WORDS on and wherever the edits lie, that the
#: keys find (tests measure it).
RECALL = 0.95
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Cells of one row of the distance table that are computed at once.
CELLS = 1 << 18
#: The table of the words that may stand at a sampled place has so many places for each item, and at most 2 ** 20.
_SPREAD = 64
_PIECE = np.uint64(0x9FB21C651E98DF25)
_PAD = np.uint64(0)


def places(reach: int, seed: int) -> np.ndarray:
    """The sampled steps of one walk, one in each of SAMPLED equal stretches of its first `reach` steps."""
    edges = np.linspace(0, reach, min(SAMPLED, reach) + 1).astype(int)
    chance = mix(np.arange(len(edges) - 1, dtype=np.uint64) + np.uint64(seed * 1000 + reach))
    return edges[:-1] + (chance % np.diff(edges).astype(np.uint64)).astype(int)


def _slot(word: np.ndarray, size: int) -> np.ndarray:
    """The place of a word's hash in a table of a power of two."""
    return word >> np.uint64(65 - size.bit_length())


def _seed(walk: int) -> np.uint64:
    return mix(np.array([walk + 1], np.uint64))[0]


def keys(h: np.ndarray, starts: np.ndarray, walk: int, sampled: np.ndarray, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of one walk from each of some places in a sequence of words.

    At each step the walk stays or goes on to the next word, by a random bit of the word and the step; the key is
    made of the words stood on at the sampled steps. With `seen`, a table of words for each of them, walks that stand
    on another word are given up.
    """
    bits = mix(h ^ _seed(walk))
    at, code = starts.copy(), np.zeros(len(starts), np.uint64)
    last, step = len(h) - 1, 0
    for n, place in enumerate(sampled):
        for j in range(step, place):
            at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(at.dtype)
            np.minimum(at, last, out=at)
        step = place
        word = h[at]
        if seen is not None:
            held = np.flatnonzero(seen[n][_slot(word, len(seen[n]))])
            starts, at, code, word = starts[held], at[held], code[held], word[held]
        code = mix(code * _PIECE + word)
    return starts, code


@dataclass
class Table:
    """Keys by one walk of one reach from all anchors: sorted, with their items, anchors and the words at the sampled places."""

    walk: int
    sampled: np.ndarray
    known: np.ndarray
    item: np.ndarray
    anchor: np.ndarray
    seen: list[np.ndarray]


@dataclass
class Items:
    """A block of items: words one after the other, sizes, allowed edits, tables of keys forwards and backwards."""

    ids: list
    tokens: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    tables: tuple[list[Table], list[Table]]


def reach_of(size: int) -> int:
    """Steps of a walk over an item of so many words from which coordinates are sampled; two words are spared for a second anchor."""
    return min(REACH, max(min(size, SAMPLED + 1), size - 2))


def anchors(size: int) -> np.ndarray:
    """Words of an item at which walks begin: every STRIDE-th, and the last from which a walk's reach stays within."""
    last = size - reach_of(size)
    return np.unique(np.append(np.arange(0, last + 1, STRIDE), last))


def block(ids: list, texts: list[str], edits: float, least_words: int = LEAST_WORDS) -> Items:
    token_lists = []
    for _, _, data, offsets in string_slices(pa.array(texts, pa.string())):
        h, _, counts = words(data, offsets)
        token_lists += np.split(h, np.cumsum(counts)[:-1])
    keep = [i for i, t in enumerate(token_lists) if len(t) >= max(1, least_words)]
    token_lists, ids = [token_lists[i] for i in keep], [ids[i] for i in keep]
    sizes = np.array([len(t) for t in token_lists], np.int64)
    begins = np.cumsum(sizes) - sizes
    tables: tuple[list[Table], list[Table]] = ([], [])
    each = [anchors(int(n)) for n in sizes]
    anchor = np.concatenate(each) if each else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sizes)), [len(a) for a in each])
    reach = np.array([reach_of(int(n)) for n in sizes], np.int64)[of]
    for back in (0, 1):
        tokens = np.concatenate([t[::-1] if back else t for t in token_lists]) if token_lists else np.zeros(0, np.uint64)
        for r in np.unique(reach):
            own = np.flatnonzero(reach == r)
            begin = begins[of[own]] + anchor[own]
            for k in range(WALKS):
                walk = 2 * k + back
                sampled = places(int(r), walk)
                seen = []
                for n in range(len(sampled)):
                    flags = np.zeros(min(1 << 20, 1 << (_SPREAD * len(own)).bit_length()), bool)
                    flags[_slot(stood(tokens, begin, walk, int(sampled[n])), len(flags))] = True
                    seen.append(flags)
                _, code = keys(tokens, begin, walk, sampled)
                order = np.argsort(code, kind="stable")
                tables[back].append(Table(walk, sampled, code[order], of[own][order], anchor[own][order], seen))
    tokens = np.concatenate(token_lists) if token_lists else np.zeros(0, np.uint64)
    return Items(ids, tokens, begins, sizes, (sizes * edits + 1e-9).astype(np.int64), tables)


def stood(h: np.ndarray, starts: np.ndarray, walk: int, step: int) -> np.ndarray:
    """The words that walks from `starts` stand on after so many steps."""
    bits, at = mix(h ^ _seed(walk)), starts.copy()
    for j in range(step):
        at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(at.dtype)
        np.minimum(at, len(h) - 1, out=at)
    return h[at]


def candidates(h: np.ndarray, row: np.ndarray, items: Items) -> np.ndarray:
    """Sorted distinct (row, item, start): windows of some texts that share a key with an item of their size.

    A start may lie before its row if the window does.
    """
    found = [np.zeros((0, 3), np.int64)]
    n = len(h)
    for back, tables in enumerate(items.tables):
        own = np.ascontiguousarray(h[::-1]) if back else h
        every = np.arange(n, dtype=np.int64)
        for t in tables:
            start, code = keys(own, every, t.walk, t.sampled, t.seen)
            if not len(start):
                continue
            low, high = np.searchsorted(t.known, code), np.searchsorted(t.known, code, "right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item, anchor, at = t.item[which], t.anchor[which], np.repeat(start, times)
            if back:  # the window ends so many words behind where the walk backwards began
                at = n - 1 - at
                found.append(np.stack([row[at], item, at - items.sizes[item] + 1 + anchor], 1))
            else:
                found.append(np.stack([row[at], item, at - anchor], 1))
    return np.unique(np.concatenate(found), axis=0)


def windows(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded words of h from each start to each end, and how many."""
    sizes = ends - starts
    width = int(sizes.max(initial=1))
    place = starts[:, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, h[np.minimum(place, len(h) - 1)], _PAD), sizes


def distances(item: np.ndarray, item_sizes: np.ndarray, region: np.ndarray, region_sizes: np.ndarray) -> np.ndarray:
    """Least edit distance of each item to any run of words of its region; rows of the table one after the other."""
    n, width = region.shape
    steps = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    outside = steps > region_sizes[:, None]
    for i in range(item.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = row[:, 0] + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (region != item[:, i : i + 1]))
        row = (np.minimum.accumulate(step - steps, 1) + steps).astype(np.int32)
        done = item_sizes == i + 1
        if done.any():
            best[done] = np.where(outside, 1 << 20, row)[done].min(1)
    return best


def may_match(item: np.ndarray, item_sizes: np.ndarray, region: np.ndarray, region_sizes: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether so many of an item's words stand in its region that the edits can make up for the others.

    Words are looked up by some bits of their hash in a table for each region, so some absent words count as present.
    """
    n, width = region.shape
    slots = 1 << (8 * width).bit_length()
    bits = np.uint64(slots - 1)
    there = np.zeros((n, slots), bool)
    row, place = np.nonzero(np.arange(width) < region_sizes[:, None])
    there[row, (region[row, place] & bits).astype(np.int64)] = True
    found = np.take_along_axis(there, (item & bits).astype(np.int64), 1) | (np.arange(item.shape[1]) >= item_sizes[:, None])
    return (~found).sum(1) <= edits


def _merged(hits: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The first start of each run of starts of one row and item that lie within the item's edits, and the last one."""
    if not len(hits):
        return hits, np.zeros(0, np.int64)
    near = items.edits[hits[:, 1]]
    new = np.ones(len(hits), bool)
    new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(1) | (hits[1:, 2] - hits[:-1, 2] > near[1:])
    # a run of many starts is cut after each stretch of the allowed edits, so that no region grows
    group = np.cumsum(new) - 1
    first = hits[new][group, 2]
    stretch = (hits[:, 2] - first) // (near + 1)
    new[1:] |= stretch[1:] != stretch[:-1]
    at = np.flatnonzero(new)
    return hits[at], hits[np.append(at[1:], len(hits)) - 1, 2]


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> np.ndarray:
    """(row, item, distance, start) of some texts: the nearest passage of each row and item within the edits."""
    h, row, counts = words(data, offsets)
    if not len(h) or not len(items.ids):
        return np.zeros((0, 4), np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    hits, last = _merged(candidates(h, row, items), items)
    order = np.argsort(items.sizes[hits[:, 1]], kind="stable")  # like sizes together: little is padded
    hits, last = hits[order], last[order]
    width = items.sizes[hits[:, 1]] + 3 * items.edits[hits[:, 1]] + 1
    out, a = [], 0
    while a < len(hits):
        b = a + max(1, int(np.searchsorted(np.arange(1, len(hits) - a + 1) * width[a:], CELLS, "right")))
        r, item, start = hits[a:b].T
        size, edits = items.sizes[item], items.edits[item]
        region, region_sizes = windows(h, np.maximum(start - edits, begins[r]), np.minimum(last[a:b] + size + edits, ends[r]))
        tokens, _ = windows(items.tokens, items.begins[item], items.begins[item] + size)
        some = np.flatnonzero(may_match(tokens, size, region, region_sizes, edits))
        r, item, start, size, edits = (x[some] for x in (r, item, start, size, edits))
        d = distances(tokens[some], size, region[some], region_sizes[some])
        out.append(np.stack([r, item, d, np.maximum(start - begins[r], 0)], 1)[d <= edits])
        a = b
    if not out:
        return np.zeros((0, 4), np.int64)
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def contamination(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", item_text: str = "text", text_col: str = "text") -> DataFrame:
    """Every row of docs with `leaks`, an array of (item, distance, start), one for each item found.

    distance is the least number of words put in, left out or replaced that turns the item into a passage near
    `start` (a word's number, from 0), at most `edits` times the item's words; words are compared in lower case
    (A-Z). The keys find a share of at least RECALL of the passages at the bound, nearly all that are nearer, and all
    that are equal. Null or empty texts have no leaks; items of fewer than `least_words` words are never found (they
    would mark nearly every document); items of the same text are found together. Repeated rows have the same leaks
    each. A text or an item of any length is compared whole, one table row at a time. A column `leaks` of docs is
    replaced. An empty benchmark leaves every array empty. A benchmark of several blocks is read in several passes,
    each written before the next.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("leaks")
    some = benchmark.where(F.col(item_text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(item_text).alias("text"))
    n_bytes = some.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(n_bytes) // block_bytes))
    kind = T.ArrayType(T.StructType([T.StructField("item", benchmark.schema[id_col].dataType)]).add("distance", "integer").add("start", "integer"))
    schema = T.StructType(list(docs.schema.fields)).add("leaks", kind)
    found = docs.withColumn("leaks", F.array().cast(kind))
    names = schema.names

    def held_against(sent):
        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                leaks = batch.column("leaks").to_pylist()
                for first, _, data, offsets in string_slices(batch.column(text_col)):
                    for row, item, distance, start in matches(data, offsets, items):
                        leaks[first + row] = [*leaks[first + row], {"item": items.ids[item], "distance": int(distance), "start": int(start)}]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, batch.schema.field("leaks").type)], names)

        return against

    for k in range(n_blocks):  # one, for a benchmark of up to block_bytes
        rows = some.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).orderBy("id", "text").collect()
        sent = spark.sparkContext.broadcast(block([r["id"] for r in rows], [r["text"] for r in rows], edits, least_words))
        found = found.mapInArrow(held_against(sent), schema)
        if k + 1 < n_blocks:
            found = save(found, "leaks")
    return found
