"""The learners of quality and toxicity against plain Python, odd rows through them, and the tables that are left."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import common, quality, toxicity

DOC = "doc_id long, text string"
WORDS = ["good", "bad", "fine", "awful", "x", "yy", "zzz", "so", "very", "much"]


def made(seed, n=120):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 15))) + ("!!" if k % 3 == 0 else "") for k in range(n)]
    return texts, [int(k % 3 == 0) for k in range(n)]


def arrays(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def plain_grams(text):
    """Words by kind and pairs of neighbours; a word twice in a row is one term."""
    w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text)
    return [("one", x) for x in w] + [("twice",) if a == b else ("two", a, b) for a, b in zip(w, w[1:])]


def test_quality_terms_are_plain_grams():
    texts, _ = made(1)
    number = {}
    for text in [*texts, "a!! ?? b b c", "", "é1 é1"]:
        index, row = quality.terms(*arrays(text))
        grams = plain_grams(text)
        assert len(index) == len(grams) and not row.any()
        for i, g in zip(index.tolist(), grams):
            assert number.setdefault(g, i) == i
    assert len(set(number.values())) >= len(number) - 2  # hashed to 2 ** 18 numbers


def plain_ftrl(samples, alpha=0.5, beta=1.0, l1=0.02, l2=0.1, rounds=3, seed=5):
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(samples)):
            freq, label = samples[k]
            total = sum(freq.values())
            x = {i: c * quality.SCALE / max(1, total) for i, c in freq.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight, z


def test_quality_learner_and_score():
    texts, labels = made(2)
    samples, plain = [], []
    for t, y in zip(texts, labels):
        index, times = np.unique(quality.terms(*arrays(t))[0], return_counts=True)
        samples.append((index, times, y))
        plain.append((dict(zip(index.tolist(), times.tolist())), y))
    model = quality.learn(samples)
    weight, seen = plain_ftrl(plain)
    assert math.isclose(model.bias, weight("bias"), rel_tol=1e-6, abs_tol=1e-9)
    for i in seen:
        if i != "bias":
            assert math.isclose(model.weights[i], weight(i), rel_tol=1e-5, abs_tol=1e-6)
    assert np.count_nonzero(model.weights) == sum(weight(i) != 0 for i in seen if i != "bias")


def plain_machine(samples, alpha=2.0, l1=8.0, l2=0.01, rate=0.3, rounds=6, lift=3.0, least=3, seed=5, factors=toxicity.FACTORS):
    """Weights, vectors and bias, term by term and pair by pair."""
    count = {}
    for t, _ in samples:
        for i in t:
            count[i] = count.get(i, 0) + 1
    used = sorted(i for i, c in count.items() if c >= least)
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.1, (len(used) + 2, factors))
    v = {i: start[k + 1].tolist() for k, i in enumerate(used)}
    vn = {i: [10.0] * factors for i in used}
    z, n = dict.fromkeys([*used, "bias"], 0.0), dict.fromkeys([*used, "bias"], 0.0)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / alpha)

    for _ in range(rounds):
        for k in rng.permutation(len(samples)):
            own, label = [i for i in samples[k][0] if i in v], samples[k][1]
            m = max(1, len(own))
            w = {i: weight(i) for i in [*own, "bias"]}
            y = sum(w.values()) + sum(sum(a * b for a, b in zip(v[i], v[j])) for x, i in enumerate(own) for j in own[:x]) / m
            g = (1 / (1 + math.exp(-max(-30, min(30, y)))) - label) * (lift if label else 1.0)
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            if abs(g) > 1e-3:
                sums = [sum(v[i][f] for i in own) for f in range(factors)]
                step = {i: [(g * (sums[f] - v[i][f]) + l2 * v[i][f]) / math.sqrt(m) for f in range(factors)] for i in own}
                for i in own:
                    for f in range(factors):
                        vn[i][f] += step[i][f] ** 2
                        v[i][f] -= rate * step[i][f] / math.sqrt(vn[i][f])
    return {i: weight(i) for i in used}, v, weight("bias")


def test_toxicity_learner():
    texts, labels = made(3, 90)
    samples = [(np.unique(toxicity.terms(*arrays(t))[0].astype(np.int64)), y) for t, y in zip(texts, labels)]
    for settings in ({}, {"l1": 0.5, "rate": 0.1, "least": 1, "lift": 1.0}):
        model = toxicity.learn(samples, **settings)
        weights, vectors, bias = plain_machine([(t.tolist(), y) for t, y in samples], **settings)
        assert math.isclose(model.bias, bias, rel_tol=1e-6, abs_tol=1e-9)
        for i, w in weights.items():
            assert math.isclose(model.weights[model.slot[i]], w, rel_tol=1e-4, abs_tol=1e-5)
            assert np.allclose(model.vectors[model.slot[i]], vectors[i], rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    """Rows of one id with different texts, a very long text, one label only."""
    texts, labels = made(4)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "another text of id three"), (3, None), (900, "good bad " * 200_000)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    marks = spark.createDataFrame([(k, y, y) for k, y in enumerate(labels)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.fit(docs, marks))
    assert got.count() == len(rows) and got.where("doc_id = 3").select("score").distinct().count() >= 2
    again = module.score(docs.where("doc_id >= 3"), module.fit(docs, marks))
    assert got.where("doc_id = 900").first()["score"] == again.where("doc_id = 900").first()["score"]
    one = module.score(docs, module.fit(docs, marks.where(f"{label} = 1"))).agg(F.min("score")).first()[0]
    assert one > 0.5 or module is toxicity


def test_cleanup(spark, tmp_path):
    common.cleanup(spark)
    kept = common.save(spark.range(3).toDF("x"), "cleanup-test")
    assert kept.count() == 3 and common.cleanup(spark) == 1 and common.cleanup(spark) == 0
    folder = common.shared_dir(spark).removeprefix("file:")
    import os

    assert not [d for d in os.listdir(folder) if d.startswith("cleanup-test")]
