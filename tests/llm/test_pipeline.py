"""Each stage of the corpus pipeline against a plain version on the stage's own input, and the whole run."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from quire.llm import common, decontamination, minhash, toxicity
from tests.llm.test_operators import edits, plain_components, plain_lines, plain_sets

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}{d}" for a in "bcdfgklm" for b in "aeiou" for c in "nrst" for d in ("a", "o", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("sf")
    items = [(k, sentence(rng, rng.randint(12, 30))) for k in range(6)]
    texts, labels = [], []
    for k in range(300):
        text = "\n".join(sentence(rng, 12) for _ in range(rng.randint(2, 6)))
        kind = k % 10
        if kind == 1:
            text += " moronic scum"
        elif kind == 3:
            text = texts[k - 1]
        elif kind == 5:
            w = texts[k - 1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 7:
            w = items[k // 10 % 6][1].split()
            w[rng.randrange(len(w))] = "edited"
            text += f"\n{sentence(rng, 3)} {' '.join(w)} {sentence(rng, 3)}"
        elif kind == 8:
            text = texts[k - 8].split("\n")[0] + "\n" + text
        texts.append(text)
        if k % 4:
            labels.append((k, 1, int(kind == 1)))
    docs = [(k, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(texts)] + [(900, None, None, None, 0), (901, "", "en", "a", 0), (902, " \n ", "en", None, 3)]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0]))


def test_stages(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicate documents", "benchmark decontamination", "mixing"]
    before = rows(docs)
    for name, stage in pipeline.STAGES:
        out = pipeline.save(stage(spark, docs, folder), "stage-test")
        after = rows(out)
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "toxicity":
            gone = {r[0] for r in before} - {r[0] for r in after}
            toxic = {r[0] for r in before if r[1] and "moronic" in r[1]}
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 3
        elif name == "line dedup":
            want = {i: t for i, (t, exact, near) in plain_lines([r[:2] for r in before]).items() if not (exact + near and not (t or "").split())}
            assert {r[0]: r[1] for r in after} == want
            assert all(r[4] == len(r[1]) for r in after if r[1] is not None)
        elif name == "near-duplicate documents":
            group = plain_components(plain_sets([r[:2] for r in before]), 80)
            assert [r[0] for r in after] == [r[0] for r in before if group[r[0]] == r[0]]
        elif name == "benchmark decontamination":
            words = {r[0]: re.findall(r"[^ \t-\r]+", r[1] or "") for r in before}
            leaky = {i for i, w in words.items() if any(edits(x.split(), w) <= len(x.split()) // 5 for _, x in items)}
            assert len(leaky) >= 10 and {r[0] for r in before} - {r[0] for r in after} == leaky
        else:
            sizes = {r[0]: len((r[1] or "").split()) for r in before}
            taken = {r["doc_id"]: r["taken"] for r in out.collect()}
            assert all(0 < t <= 2 * sizes[i] and t % sizes[i] == 0 for i, t in taken.items())
            goals = {r["source"]: r["target"] for r in out.collect()}
            for source, target in goals.items():
                assert abs(sum(r["taken"] for r in out.collect() if r["source"] == source) - target) <= 40
        docs, before = out, after
    assert rows(pipeline.run(spark, folder).select("doc_id", "taken")) == rows(docs.select("doc_id", "taken"))


def test_stages_of_nothing(spark, tables, tmp_path):
    folder, _ = tables
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    docs = spark.read.schema(DOCS).parquet(str(tmp_path / "none"))
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        docs = docs if "text" not in out.columns else pipeline.save(out, "none-test")


def test_what_a_worker_holds_beside_its_texts():
    """Over 6 MB of texts in one batch each Python step of the pipeline allocates a few MB at once, and keeps less."""
    rng = random.Random(5)
    texts = pa.array([sentence(rng, 300) for _ in range(4500)])
    assert texts.nbytes > 6e6
    items = decontamination.block(list(range(20)), [sentence(rng, 30) for _ in range(20)], 0.2)
    column = lambda *names: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, pa.array([0] * len(texts))], [*names, "label"])
    model = toxicity.learn([])
    steps = {
        "scores": lambda: toxicity._score(model, texts),
        "sketches": lambda: [None for _ in minhash._sketch(iter([column("id", "text")]), "id", "text")],
        "sets": lambda: [None for _ in minhash._sets(iter([column("rep", "text")]))],
        "leaks": lambda: [None for _, _, data, offsets in common.string_slices(texts) if len(decontamination.matches(data, offsets, items)) < 0],
    }
    peaks = {}
    for name, step in steps.items():
        common._POWERS.clear()
        tracemalloc.start()
        step()
        kept, peaks[name] = (n / 1e6 for n in tracemalloc.get_traced_memory())
        tracemalloc.stop()
        assert kept < 12, (name, kept)
    assert max(peaks.values()) < 40, peaks


@pytest.mark.parametrize("stage", [pipeline.drop_toxic, pipeline.drop_near_duplicates, pipeline.drop_contaminated])
def test_workers_get_bounded_batches(spark, tables, tmp_path, stage):
    """Rows go to Python by bytes, not 10,000 at a time whatever their size."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    stage(spark, spark.read.schema(DOCS).parquet(str(tmp_path / "none")), tables[0])
    wide = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) as text")
    sizes = [r["n"] for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert sum(sizes) > 30e6 and max(sizes) <= 1.1 * common.BATCH_BYTES
