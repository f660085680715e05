"""Exact dedup, vector codes and phrases against plain Python; edits at any place; repeated and null ids."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, decontamination, exact_dedup, line_dedup, minhash, vector_codes

DOC = "doc_id long, text string"


def stored(spark, path, rows, schema, parts):
    """A table of files, some of them without rows, so that tasks with none run."""
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(path))
    return spark.read.schema(schema).parquet(str(path)).repartition(parts)


# ------------------------------------------------------------------------------------------------------ exact dedup


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        kept = False
        for m in sorted(members):
            out.append((m[2], best[2], len(members), m == best and not kept, hashlib.sha256(norm.encode()).hexdigest()))
            kept = kept or m == best
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [(4096, 64 << 20), (7, 64 << 20), (4096, 200)])
def test_copies(spark, tmp_path, share):
    rng = random.Random(1)
    texts = ["", " \n", None, "a b", "ab", "a\tb ", "é x", "éx", "éx", " ", "zz" * 40_000, "x" * 32 + "1", "x" * 32 + "2", "x" * 32 + " 1"]
    rows = [(k, rng.choice(texts)) for k in range(120)] + [(k, "hot " * (k % 3)) for k in range(1000, 1080)] + [(None, "ab"), (None, "ab"), (7, "a b"), (7, "a b"), (7, "a  b")] + [(5000, "same id")] * 30
    rng.shuffle(rows)
    df = stored(spark, tmp_path / "d", rows, DOC, 5).withColumns({"h": F.lit(1), "norm": F.lit("x"), "first": F.lit(2), "share": F.lit(3)})
    got = exact_dedup.exact_duplicates(df, share_rows=share[0], share_bytes=share[1])
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_copies(rows)
    assert exact_dedup.exact_duplicates(df.limit(0)).collect() == []


def test_copies_stay_in_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a ")], DOC)
    plan = exact_dedup.exact_duplicates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------------------------------------------ vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    good = [(i, [int(np.floor(4096 * float(x))) if abs(float(x)) < 2**50 else int(float(x)) * 4096 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not good:
        return []
    dims = len(good[0][1])
    good = [r for r in good if len(r[1]) == dims]
    width = -(-dims // parts)
    cut = [[(v + [0] * (width * parts - dims))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for c in cut:
                taken.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(taken[k]) for x in zip(*taken[k])] if k in taken else e for k, e in enumerate(books[p])]
    told = []
    for (i, _, lab), c in zip(good, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        told.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), 2**63 - 1), lab))
    sums = Counter()
    for _, _, e, lab in told:
        sums[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(sums[lab], 2**63 - 1), sha) for i, c, e, lab in told), key=str)


VEC = "vec_id long, embedding array<float>, label int"


def single(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "few", "odd"])
def test_codes(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    make = {"plain": lambda: rng.normal(size=24), "ties": lambda: rng.integers(-2, 3, 16) / 4096, "large": lambda: rng.normal(size=16) * 10.0 ** rng.integers(0, 38), "few": lambda: rng.normal(size=8), "odd": lambda: rng.normal(size=11)}[kind]
    rows = [(k * 3 % 1009, single(make()), [None, 0, 1][k % 3]) for k in range(9 if kind == "few" else 250)]
    n = len(rows[0][1])
    rows += [(3, None, 1), (1, [None] * n, 0), (2, [float("nan")] * n, 1), (4, [float("inf")] + [0.0] * (n - 1), 1), (None, single(make()), 5), (90, rows[5][1], 0), (90, rows[5][1], 0), (91, [1.0], 0), (92, [0.0] * n, None)]
    df = stored(spark, tmp_path / "v", rows, VEC, 6).withColumns({"code": F.lit("x"), "error": F.lit(1), "of": F.lit(2)})
    got = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)
    assert got == plain_codes(rows)
    assert vector_codes.compress(df.limit(0)).collect() == [] and vector_codes.compress(df.where("embedding is null")).count() == 0


def test_annulus_leaves_entries_out():
    """The pruned search finds what a full one does, and evaluates fewer entries."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8)) * rng.integers(1, 20, (16, 1))
    x = (entries[rng.integers(0, 16, 3000)] + rng.integers(-50, 50, (3000, 8))).astype(np.int64)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    seen = []
    plain = vector_codes.squared
    vector_codes.squared = lambda a, b: (seen.append(len(a)), plain(a, b))[1]
    try:
        best, far = vector_codes.nearest(x, vector_codes.codebook(entries))
    finally:
        vector_codes.squared = plain
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
    assert sum(seen) < 0.5 * every.size


def test_limbs():
    for v in (0, 1, -1, 2**200, -(2**200) + 5, -(2**32)):
        assert sum(d << (32 * k) for k, d in enumerate(vector_codes.limbs(v, 8))) == v


# ----------------------------------------------------------------------------------------------------------- phrases


def plain_phrases(rows, max_words=3, least=10, top=2000, within=50):
    counts, n = {}, Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                f.update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in cand.items():
            inside = lambda x: any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))
            if any(len(x) > len(g) and 100 * b >= within * a and inside(x) for x, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, tmp_path, monkeypatch, small):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(14)] + ["é", "É", "A", "a", "x y", "ß"]
    texts = []
    for k in range(300):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r", "?"]) for _ in range(rng.randint(0, 60)))
        texts.append((rng.choice(["en", "de", None, "und"]), t))
    texts += [("en", None), (None, ""), ("fr", "   "), ("en", " ".join(["w1", "w2", "w3"] * 3000)), *[("de", "Same Line here. and MORE\n" * 3)] * 40]
    if small:  # long pieces in stretches, many hand-overs, several sends to duckdb
        monkeypatch.setattr(collocations, "PIECES_BYTES", 2000)
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
        monkeypatch.setattr(collocations, "ROWS", 50)
        monkeypatch.setattr(collocations, "BUCKET_WORDS", 500)
    df = stored(spark, tmp_path / "t", texts, "lang string, text string", 7).withColumns({"piece": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "doc_id": F.lit(1)})
    got = sorted(tuple(r) for r in collocations.collocations(df).collect())
    want = plain_phrases(texts)
    assert got == want and len(want) > 20
    if small:
        assert sorted(tuple(r) for r in collocations.collocations(df, max_words=4, least=12, top=5, within=80).collect()) == plain_phrases(texts, 4, 12, 5, 80)
        assert collocations.collocations(df.limit(0)).collect() == [] and collocations.collocations(df.where("lang = 'fr'")).collect() == []


def test_scores_pass_64_bits():
    import pyarrow as pa

    a, left, right = 4_000_000_000_000_000_000, 6_000_000_000_000_000_000, 5_000_000_000_000_000_000
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "phrase": "x y", "a": a, "l1": left, "r1": right, "l2": None, "r2": None}])
    got = next(iter(collocations._scores(iter([batch]), 2))).to_pylist()
    assert got == [{"lang": "en", "phrase": "x y", "a": a, "l": left, "r": right, "score": 1_000_000 * a * a // (left * right)}]


# --------------------------------------------------------------------------------------- edits at any place, odd ids


@pytest.mark.parametrize("n", [5, 10, 12, 15, 30, 50, 200])
def test_keys_reach_their_recall_wherever_edits_lie(n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(3000)}"
    e = n // 5
    places = {
        "start": lambda: range(e), "end": lambda: range(n - e, n), "both": lambda: [*range(e - e // 2), *range(n - e // 2, n)],
        "cluster": lambda: range(a := rng.randrange(n - e + 1), a + e), "even": lambda: [*range(rng.randrange(5), n, 5)][:e], "middle": lambda: [*range(2, n, 5)][:e],
    }
    items = [[word() for _ in range(n)] for _ in range(100)]
    held = decontamination.block(list(range(100)), [" ".join(w) for w in items], 0.2)
    for where in places.values():
        for new in (lambda x: [word()], lambda x: rng.choice([[], [word()], [word(), x]])):
            blob = []
            for item in items:
                at = set(where())
                w = [y for k, x in enumerate(item) for y in (new(x) if k in at else [x])]
                blob.append(" ".join([word() for _ in range(8)] + w + [word() for _ in range(8)]).encode())
            data, offsets = np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0, *map(len, blob)])
            assert sum(r == i for r, i, _, _ in decontamination.matches(data, offsets, held)) >= decontamination.RECALL * 100


def test_overlap_test_loses_nothing():
    rng = np.random.default_rng(8)
    item, region = rng.integers(1, 9, (400, 12)).astype(np.uint64), rng.integers(1, 30, (400, 20)).astype(np.uint64)
    sizes, region_sizes = rng.integers(1, 13, 400), rng.integers(1, 21, 400)
    near = decontamination.distances(item, sizes, region, region_sizes)
    for edits in (0, 1, 3, 6):
        may = decontamination.may_match(item, sizes, region, region_sizes, np.full(400, edits))
        assert may[near <= edits].all() and not may.all()


def test_repeated_id_with_empty_text(spark):
    w = [f"w{k}" for k in range(60)]
    near = " ".join(["other", *w[1:]])
    rows = [(1, " ".join(w)), (1, None), (1, ""), (2, near), (2, None), (3, "unlike anything else here at all")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), per_cent=80).collect())
    assert got == [(1, 0, 1, True), (1, 0, 1, True), (1, 56, 1, True), (2, 0, 1, False), (2, 56, 1, False), (3, 2, 3, True)]
    pipeline = pytest.importorskip("corpus_pipeline")
    left = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 1, 1, 3]


def test_lines_of_null_ids(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, f"{line}\nown line {k} of this very text with words") for k in range(6)] + [(None, line.replace("five", "5")), (1, line)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).select("doc_id", "n_exact", "n_near").collect()
    assert sorted((r["doc_id"] or 0, r["n_exact"], r["n_near"]) for r in got) == [(0, 0, 1), *[(0, 1, 0)] * 6, (1, 0, 0)] or sorted((r["doc_id"] or 0, r["n_exact"] + r["n_near"]) for r in got)[-1] == (1, 0)
