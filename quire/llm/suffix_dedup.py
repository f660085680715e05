"""Exact passage dedup: every 50-byte string that also starts in an earlier document, by a distributed suffix sort.

Windows of 50 bytes are the suffixes, cut at that length, that are sorted. They are grouped by their minimizer (the
least hash of a 16-byte gram within the window), so equal windows have it at the same place and one short string
around it holds all windows of a stretch. Documents are dealt into runs of a few megabytes.

1. Every run sends sorted fingerprints of the 33 or 34 bytes that all windows on one side of a minimizer share; a
   fingerprint that no other document has drops these windows.
2. Of the rest every run sorts its distinct strings and sends them front-coded: the length of the prefix shared with
   the string before, and what follows. A reducer merges the runs with a loser tree that compares strings only
   behind the prefixes known to be equal, and answers each run with the earliest document of each string and the
   windows that even that document repeats.
3. Every run marks the windows that an earlier document has and cuts their bytes out.

The runs' texts lie in a table bucketed by run: the answers travel to them, the texts don't move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _BYTE, _power_tables, bound_batches, mix, partitions, rows_of, save, shared_dir, string_slices

#: Bytes of a window and of a gram; offsets of the gram up to SIDE belong to the right side.
WINDOW, GRAM, SIDE = 50, 16, 17
SPAN = WINDOW - GRAM
#: Bytes of a run; one bucket of fingerprints or strings for so many bytes of text.
RUN_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: A fingerprint around which so many different strings stand, over all runs, is spread: its windows are sorted one by
#: one, over all buckets. Runs with one string each are told apart by a byte of its hash; so many bytes count as hot.
HOT, HOT_BYTES = 4096, 224
_LAST = (1 << 63) - 1
_UNITS = np.dtype([("at", "<i4"), ("low", "u1"), ("high", "u1")])


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return total, down


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(at, low, high): gram places and the offsets, on one side, of the windows whose minimizer they are."""
    n = len(data) - GRAM + 1
    if n < WINDOW - GRAM + 1:
        return np.zeros(0, _UNITS)
    total, down = _prefix_sums(data)
    gram = (total[GRAM:] - total[:n]) * down[:n]
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, step = SPAN + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.arange(len(place))
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(place)] - begin >= WINDOW
    begin, place = begin[left], place[left]
    if not len(begin):
        return np.zeros(0, _UNITS)
    off = place - begin
    right = off <= SIDE
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    out = np.empty(len(first), _UNITS)
    out["at"], out["high"], out["low"] = place[first], off[first], off[last]
    return out


def fingerprints(data: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Hash of what all windows of a unit share: behind the gram's place, or on the left side also before it."""
    total, down = _prefix_sums(data)
    right = u["low"] <= SIDE
    a = u["at"].astype(np.int64) - np.where(right, 0, SIDE + 1)
    b = u["at"].astype(np.int64) + np.where(right, WINDOW - SIDE, GRAM)
    return mix((total[b] - total[a]) * down[a] + right.astype(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("id").fill_null(_LAST).to_numpy()
        for first, end, data, offsets in string_slices(batch.column("text"), RUN_BYTES):
            found = [np.zeros(0, _UNITS)]
            row = 0
            while row < end - first:  # units of some rows at a time, for the caches
                stop = min(end - first, max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 18)))))
                part = units(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
                part["at"] += offsets[row]
                found.append(part)
                row = stop
            u = np.concatenate(found)
            cols = [ids[first:end].astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), data.tobytes(), np.diff(u["at"], prepend=np.int32(0)).tobytes(), u["low"].tobytes(), u["high"].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([run]), *(pa.array([c], pa.binary()) for c in cols)], ["run", "ids", "ends", "data", "at", "low", "high"])
            run += 1


_RUN_SCHEMA = "run long, ids binary, ends binary, data binary, at binary, low binary, high binary"


class Run:
    """A run's documents and units."""

    def __init__(self, row: dict):
        self.run = row["run"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.offsets = np.frombuffer(row["ends"], "<i8")
        self.data = np.frombuffer(row["data"], np.uint8)
        self.units = np.empty(len(row["low"]), _UNITS)
        self.units["at"] = np.cumsum(np.frombuffer(row["at"], "<i4"))
        self.units["low"], self.units["high"] = np.frombuffer(row["low"], np.uint8), np.frombuffer(row["high"], np.uint8)
        self.prints = fingerprints(self.data, self.units) if len(self.units) else np.zeros(0, np.uint64)
        self.docs = self.ids[np.searchsorted(self.offsets, self.units["at"], "right") - 1] if len(self.units) else np.zeros(0, np.int64)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct bucket and print, the row of each unit among them, how many units each has)."""
        code = (self.prints >> np.uint64(32)) % np.uint64(n) << np.uint64(32) | self.prints & np.uint64(0xFFFFFFFF)
        return np.unique(code, return_inverse=True, return_counts=True)

    def strings(self, row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many different strings, 255 at most, and a byte of the least one's hash) of each distinct print."""
        if not len(times):
            return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        total, down = _prefix_sums(self.data)
        at = self.units["at"].astype(np.int64)
        begin, end = at - self.units["high"], at - self.units["low"] + WINDOW
        whole = mix((total[end] - total[begin]) * down[begin])
        count, byte = np.ones(len(times), np.int64), np.zeros(len(times), np.uint8)
        byte[row] = (whole >> np.uint64(56)).astype(np.uint8)
        some = np.flatnonzero(times[row] > 1)
        order = some[np.lexsort((whole[some], row[some]))]
        if len(order):
            first = np.ones(len(order), bool)
            first[1:] = row[order[1:]] != row[order[:-1]]
            new = first.copy()
            new[1:] |= whole[order[1:]] != whole[order[:-1]]
            many = np.bincount(row[order[new]], minlength=len(times))
            count = np.where(many > 0, many, count)
            byte[row[order[first]]] = (whole[order[first]] >> np.uint64(56)).astype(np.uint8)
        return np.minimum(count, 255).astype(np.uint8), byte

    def several(self, row: np.ndarray, n: int) -> np.ndarray:
        """Which of the distinct prints more than one document of the run has."""
        least, most = np.full(n, _LAST), np.full(n, -_LAST)
        np.minimum.at(least, row, self.docs)
        np.maximum.at(most, row, self.docs)
        return least != most


def _send_prints(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in rows_of(batch):
            run = Run(row)
            code, of, times = run.buckets(n_buckets)
            bucket = (code >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            blobs = lambda x, kind: pa.array([x[edges[b] : edges[b + 1]].astype(kind).tobytes() for b in some], pa.binary())
            count, byte = run.strings(of, times)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), run.run)), blobs(code, "<u4"), blobs(count, "u1"), blobs(byte, "u1")], ["bucket", "run", "prints", "counts", "bytes"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each bucket, of batches sorted by it."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["bucket"] != row["bucket"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _answer_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run's prints of a bucket: which another run has, and around which very many strings stand."""
    for rows in _by_bucket(batches):
        lists = [np.frombuffer(r["prints"], "<u4") for r in rows]
        gathered = lambda name: np.concatenate([np.frombuffer(r[name], np.uint8) for r in rows])
        count, byte = gathered("counts"), gathered("bytes")
        code, of, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        strings = np.bincount(of, np.where(count > 1, count, 0), len(code))
        # the different bytes of the prints that many runs have
        some = np.flatnonzero(times[of] >= min(HOT, HOT_BYTES))
        seen = np.unique(of[some] << 8 | byte[some]) >> 8
        often = (strings >= HOT) | (np.bincount(seen, minlength=len(code)) >= HOT_BYTES)
        shared, often = times[of] > 1, often[of]
        at = np.cumsum([0, *map(len, lists)])
        packed = lambda x: pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r["run"] for r in rows]), pa.array([r["bucket"] for r in rows]), packed(shared), packed(often)], ["run", "bucket", "shared", "often"])


# ------------------------------------------------------------------------------------ strings around the grams

_KEY = WINDOW + SPAN + 3


def entries(run: Run, prints: list[dict], n_buckets: int):
    """(unit of each entry, offsets low and high, entry's row among the distinct strings, their keys, buckets).

    A key is the side, the shared bytes, what follows them, what stands before them, and the lengths.
    """
    code, of, times = run.buckets(n_buckets)
    shared, hot = run.several(of, len(code)), np.zeros(len(code), bool)
    bucket = (code >> np.uint64(32)).astype(np.int64)
    for row in prints:
        a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
        shared[a:b] |= np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=b - a).astype(bool)
        hot[a:b] = np.unpackbits(np.frombuffer(row["often"], np.uint8), count=b - a).astype(bool)
    kept = np.flatnonzero(shared[of])
    spread = hot[of[kept]]
    low, high = run.units["low"][kept].astype(np.int64), run.units["high"][kept].astype(np.int64)
    times = np.where(spread, high - low + 1, 1)
    unit = np.repeat(kept, times)
    step = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times)
    alone = np.repeat(spread, times)
    low = np.where(alone, np.repeat(low, times) + step, np.repeat(low, times))
    high = np.where(alone, low, np.repeat(high, times))
    at = run.units["at"][unit].astype(np.int64)
    right = low <= SIDE
    first = at - np.where(right, 0, SIDE + 1)  # where the shared bytes begin
    begin, end = at - high, at - low + WINDOW
    n_behind, n_before = end - first, first - begin
    keys = np.zeros((len(unit), _KEY), np.uint8)
    column = np.arange(WINDOW + SPAN)
    for a in range(0, len(unit), 1 << 15):  # the cut of the strings, some at a time
        s = slice(a, a + (1 << 15))
        c = column[None, :]
        behind = c < n_behind[s, None]
        source = np.where(behind, first[s, None] + c, begin[s, None] + c - n_behind[s, None])
        inside = c < (n_behind + n_before)[s, None]
        keys[s, 1:-2] = np.where(inside, run.data[np.minimum(source, len(run.data) - 1)], 0)
    keys[:, 0] = 1 + right
    keys[:, -2], keys[:, -1] = n_before, n_behind
    flat = np.ascontiguousarray(keys).view(f"S{_KEY}").ravel()
    # strings that meet are in one bucket: by what they share, or, spread, by themselves
    value = mix(run.prints[unit] + np.uint64(0x1F3D5B79))
    if alone.any():
        some = np.flatnonzero(alone)
        own = np.zeros(len(some), np.uint64)
        for k in range(0, _KEY):
            own = own * np.uint64(0x100000001B3) + keys[some, k]
        value[some] = mix(own)
    to = (value >> np.uint64(33)).astype(np.int64) % n_buckets
    order = np.lexsort((flat, to))
    new = np.ones(len(order), bool)
    new[1:] = (flat[order[1:]] != flat[order[:-1]]) | (to[order[1:]] != to[order[:-1]])
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    chosen = order[new]
    return unit, low, high, row, keys[chosen], to[chosen]


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(shared prefix length of each sorted key with the one before, the remaining bytes of all of them)."""
    lcp = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        lcp[1:] = (keys[1:] != keys[:-1]).argmax(1)
    return lcp, keys[np.arange(keys.shape[1]) >= lcp[:, None]].tobytes()


def _send_strings(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "run", "lcp", "bytes", "docs"]
    for batch in batches:
        for data in rows_of(batch):
            run = Run(data)
            unit, _, _, row, keys, to = entries(run, data["answers"] or [], n_buckets)
            least = np.full(len(keys), _LAST)
            np.minimum.at(least, row, run.docs[unit])
            edges = np.searchsorted(to, np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            coded = [front_code(keys[edges[b] : edges[b + 1]]) for b in some]
            docs = [least[edges[b] : edges[b + 1]].astype("<i8").tobytes() for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), run.run)), pa.array([c[0].tobytes() for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary()), pa.array(docs, pa.binary())], names)


def _decoded(lcp: bytes, rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared prefix length, key) of a front-coded run."""
    key, at = b"", 0
    for n in lcp:
        end = at + _KEY - n
        key = key[:n] + rest[at:end]
        at = end
        yield n, key


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(prefix length shared with the key before, key, run) of sorted front-coded runs, in order.

    A loser tree: each inner node keeps the loser of its match and how long a prefix that key shares with the
    winner that went by. A key that shares a longer prefix with the last winner is the smaller one, so strings are
    compared only where both lengths are equal, and then from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    key: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, source in enumerate(sources):
        _, key[i] = next(source, (0, None))

    def beats(a: int, b: int) -> bool:
        """Whether a's key comes first; the loser's shared length becomes that with the winner."""
        x, y = key[a], key[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        if x == y:
            shared[b if a < b else a] = _KEY
            return a < b
        n = shared[a]
        bits = (int.from_bytes(x[n:]) ^ int.from_bytes(y[n:])).bit_length()
        m = _KEY - (bits + 7) // 8
        first = x < y
        shared[b if first else a] = m
        return first

    lost = [0] * k  # node 0 holds the winner

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            lost[node] = b
            return a
        lost[node] = a
        return b

    winner = play(1)
    while key[winner] is not None:
        yield shared[winner], key[winner], winner
        shared[winner], key[winner] = next(sources[winner], (0, None))
        node = (winner + k) // 2
        while node:
            other = lost[node]
            # beats(), in place: most matches are decided by the lengths alone
            if key[other] is not None and (key[winner] is None or shared[other] > shared[winner] or (shared[other] == shared[winner] and not beats(winner, other))):
                lost[node], winner = winner, other
            node //= 2


def _windows(key: bytes) -> list[tuple[int, bytes]]:
    """(offset, window) of the windows that a key holds."""
    right, before, behind = key[0] == 2, key[-2], key[-1]
    text = key[1 + behind : 1 + behind + before] + key[1 : 1 + behind]
    high = before + (0 if right else SIDE + 1)
    return [(high - k, text[k : k + WINDOW]) for k in range(len(text) - WINDOW + 1)]


def _judged(group: list[tuple[bytes, int]]) -> list[int]:
    """For each distinct key of a group with its earliest document: bits of the windows that an earlier one has."""
    if len(group) == 1:
        return [0]
    first: dict[bytes, int] = {}
    held = [_windows(key) for key, _ in group]
    for windows, (_, doc) in zip(held, group):
        for _, w in windows:
            if first.get(w, _LAST) >= doc:
                first[w] = doc
    return [sum(1 << offset for offset, w in windows if first[w] < doc) for windows, (_, doc) in zip(held, group)]


def _answer_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run's strings of a bucket: the earliest document, and the windows that even that one repeats."""
    for rows in _by_bucket(batches):
        docs = [np.frombuffer(r["docs"], "<i8").tolist() for r in rows]
        out_doc = [[0] * len(d) for d in docs]
        out_bits = [[0] * len(d) for d in docs]
        nth = [0] * len(rows)
        group: list[tuple[bytes, int]] = []
        held: list[list[tuple[int, int]]] = []

        def close():
            for bits, (_, doc), members in zip(_judged(group), group, held):
                for r, i in members:
                    out_doc[r][i], out_bits[r][i] = doc, bits

        for lcp, key, r in merge([_decoded(x["lcp"], x["bytes"]) for x in rows]):
            i = nth[r]
            nth[r] += 1
            doc = docs[r][i]
            if lcp == _KEY:
                if doc < group[-1][1]:
                    group[-1] = key, doc
                held[-1].append((r, i))
                continue
            if lcp < (1 + WINDOW - SIDE if key[0] == 2 else 1 + SIDE + 1 + GRAM):
                close()
                group, held = [], []
            group.append((key, doc))
            held.append([(r, i)])
        close()
        blob = lambda lists, kind: pa.array([np.array(x, kind).tobytes() for x in lists], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r["run"] for r in rows]), pa.array([r["bucket"] for r in rows]), blob(out_doc, "<i8"), blob(out_bits, "<u8")], ["run", "bucket", "docs", "bits"])


def removed(run: Run, prints: list[dict], strings: list[dict], n_buckets: int) -> np.ndarray:
    """Which bytes of a run go."""
    unit, low, high, row, keys, to = entries(run, prints, n_buckets)
    doc, bits = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
    for x in strings:
        a, b = np.searchsorted(to, [x["bucket"], x["bucket"] + 1])
        doc[a:b], bits[a:b] = np.frombuffer(x["docs"], "<i8"), np.frombuffer(x["bits"], "<u8")
    own = run.docs[unit]
    later = own > doc[row]
    at = run.units["at"][unit].astype(np.int64)
    change = np.zeros(len(run.data) + 1, np.int32)
    np.add.at(change, (at - high)[later], 1)
    np.add.at(change, (at - low + WINDOW)[later], -1)
    mask = np.where(later, np.uint64(0), bits[row])
    for k in range(SPAN + 1):
        some = np.flatnonzero((mask >> np.uint64(k)) & np.uint64(1))
        if len(some):
            np.add.at(change, at[some] - k, 1)
            np.add.at(change, at[some] - k + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        for data in rows_of(batch):
            run = Run(data)
            gone = removed(run, data["answers"] or [], data["strings"] or [], n_buckets)
            rows = []
            for i, (a, b) in enumerate(zip(run.offsets, run.offsets[1:])):
                g = gone[a:b]
                kept = run.data[a:b][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                rows.append((None if run.ids[i] == _LAST else int(run.ids[i]), int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def dedup_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; kept is binary.

    A byte goes if it lies in a 50-byte string, of the UTF-8 bytes of the text, that also starts in a document with
    a smaller id; strings are judged on the input. Null text: no bytes. Rows of one id are equally early: neither
    takes the other's bytes. A null id comes last. Ids are whole numbers. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    name, n_files = f"suffix_runs_{uuid.uuid4().hex}", partitions(spark)
    bound_batches(spark)  # a run is a row of megabytes: a Python worker holds a few at a time
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = source.mapInArrow(_runs, _RUN_SCHEMA)
    made.write.bucketBy(n_files, "run").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    runs = spark.table(name)
    n_bytes = runs.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    n_buckets = max(1, -(-int(n_bytes) // BUCKET_BYTES))
    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    gathered = lambda df, to: df.groupBy("run").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "run"])).alias(to))
    prints = runs.mapInArrow(lambda b: _send_prints(b, n_buckets), "bucket long, run long, prints binary, counts binary, bytes binary")
    prints = save(dealt(prints).mapInArrow(_answer_prints, "run long, bucket long, shared binary, often binary"), "suffix-prints")
    with_prints = runs.join(gathered(prints, "answers"), "run", "left")
    strings = with_prints.mapInArrow(lambda b: _send_strings(b, n_buckets), "bucket long, run long, lcp binary, bytes binary, docs binary")
    strings = save(dealt(strings).mapInArrow(_answer_strings, "run long, bucket long, docs binary, bits binary"), "suffix-strings")
    ready = with_prints.join(gathered(strings, "strings"), "run", "left")
    return ready.mapInArrow(lambda b: _cut(b, n_buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
