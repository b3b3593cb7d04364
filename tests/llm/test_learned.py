"""Held-out accuracy of the learned scores, and their edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from pitlake.llm import quality, toxicity
from pitlake.llm.queries import table

FOLDER = "/root/testdata/sf0.1"


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}


def test_quality_held_out(spark, labels):
    rows = quality.quality(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 100 and np.mean([a == b for a, b in own]) > 0.97


def test_toxicity_held_out(spark, labels):
    rows = toxicity.toxicity(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    own = [(r.predicted, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(a and b for a, b in own)
    assert hits > 0.85 * sum(b for _, b in own) and hits > 0.75 * sum(a for a, _ in own)


def test_misspellings_share_grams():
    def score(model, *texts):
        return model.score(pa.array(texts))

    rng = np.random.default_rng(0)
    calm = ["river", "stone", "window", "garden", "morning", "letter", "market", "summer", "yellow", "bridge"]
    texts = [" ".join(rng.choice(calm, 30)) for _ in range(400)]
    y = [i % 4 == 0 for i in range(400)]
    texts = [t + " dreadful scoundrel" if bad else t for t, bad in zip(texts, y, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([int(v) for v in y]), pa.array(texts)], names=["label", "text"])
    b = next(toxicity._bags([batch]))
    bags = [(k, np.frombuffer(i, np.uint32), np.frombuffer(w, np.float32)) for k, i, w in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    model = toxicity.Model(*toxicity.fit(bags))
    clean, bad, misspelt = score(model, " ".join(calm * 3), "river stone dreadful scoundrel", "river stone dreadfull scoundrell")
    assert clean < 0.7 <= bad and misspelt > 0.7
    assert score(model, None, "").tolist() == score(model, "", "").tolist()


@pytest.mark.parametrize("run,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_edges(spark, run, label):
    docs = [(i, f"alpha beta {i} gamma" if i % 2 else "!! ## !! $$ !!") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "alpha"), (3, docs[3][1]), (102, "w" * 400_000)]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, score int, label string").repartition(2)
    marks = [(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 1), (5, None, None), (999, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = run(df, labels).collect()
    assert len(rows) == len(docs) and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (100, 101)}) == 1 and len({r.score for r in rows if r.doc_id == 3}) == 1
    assert sum(r.held_out is None for r in rows) == 0
    one = run(df, labels.where(f"{label} = 1"))
    assert {r.predicted for r in one.collect()} == ({1} if label == "quality" else {0})
    assert run(df, labels.limit(0)).count() == len(docs) and run(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("each", [1, 3])
def test_a_few_labelled_rows_are_fitted(spark, each):
    bad, good = "you rotten stinking scum", "the weather was mild today"
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][: 2 * each]
    docs = [(i, bad if k % 2 else good) for k, i in enumerate(learn)] + [(1000, bad), (1001, good)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learn)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, labels).collect()}
    assert got[1000] == 1 and got[1001] == 0
    assert {r.text for r in toxicity.clean(df, labels).collect()} == {good}


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, None, None)], "doc_id long, text string, _text int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxicity.clean(df, labels).collect())) == [(1, "x", 2), (2, None, None)]


def test_repeated_label_rows_count_once(spark):
    """30 label rows a key leave the sample as it is without them."""
    def drawn(copies):
        marks = [(i, int(i % 4 == 0)) for i in range(800) for _ in range(copies)]
        known = toxicity.known_labels(spark.createDataFrame(marks, "doc_id long, toxic int"), "toxic", "doc_id", 3, 1)
        counts = toxicity.label_counts(known)
        return tuple(counts), sorted(map(tuple, toxicity.sample(known, 100, counts).collect()))

    counts, rows = drawn(1)
    assert counts == tuple(sum(remainder(i, 3) != 1 and (i % 4 == 0) == one for i in range(800)) for one in (False, True))
    assert sum(y for _, y in rows) == 100 and len(rows) == 400 and drawn(30) == (counts, rows)


@pytest.mark.parametrize("run,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_repeated_label_rows_do_not_move_scores(spark, run, label):
    """Every key 40 times, one key of class 1 for a third of all rows, one also with the other label."""
    docs = [(i, f"alpha beta {i} gamma" if i % 2 else "!! ## dreadful !! $$ !!") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    one = next(i for i in range(1, 400, 2) if remainder(i, 3) != 1 and remainder(i, 5) != 0)
    plain = [(i, i % 2) for i in range(400)]
    many = plain * 40 + [(one, 1)] * 8000 + [(one, 0)]
    scores = [{r.doc_id: r.score for r in run(df, spark.createDataFrame(m, f"doc_id long, {label} int"), max_rows=40).collect()} for m in (plain, many)]
    assert scores[0] == pytest.approx(scores[1]) and len({round(v, 3) for v in scores[0].values()}) > 1


def test_copies_and_texts_of_one_key_are_bounded(spark):
    """A key with a third of the documents: copies count once, and at most TEXTS of its texts are kept."""
    rows = [(1, 1, f"h{i % 50}", i % 50) for i in range(3000)] + [(2, 0, "a", 7)] * 500 + [(None, 0, None, 9)] * 500
    got = toxicity.per_key(spark.createDataFrame(rows, "k long, y int, v string, h long").repartition(5), ["k", "y"], "h", ["v"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, f"h{i}") for i in range(toxicity.TEXTS)] + [(2, 0, "a"), (None, 0, None)], key=str)


@pytest.mark.parametrize("run,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_copies_of_documents_do_not_move_scores(spark, run, label):
    docs = [(i, f"alpha beta {i} gamma" if i % 2 else f"!! ## dreadful {i} !! $$ !!") for i in range(200)]
    one = next(i for i in range(0, 200, 2) if remainder(i, 3) != 1 and remainder(i, 5) != 0)  # with the label of the others
    labels = spark.createDataFrame([(i, int(i == one or i % 2)) for i in range(200)], f"doc_id long, {label} int")
    plain, many = (spark.createDataFrame(d, "doc_id long, text string").repartition(3) for d in (docs, docs + [docs[one]] * 3000))
    scores = [{r.doc_id: r.score for r in run(d, labels).collect()} for d in (plain, many)]
    assert scores[0] == pytest.approx(scores[1], abs=0.01) and len({round(v, 3) for v in scores[0].values()}) > 1


@pytest.mark.parametrize("every", [3, 500])
def test_quality_learns_from_all_rows(spark, every):
    """Mean, weights, cut and slope are those of all labelled rows, in several blocks, also where one class is rare."""
    rng = np.random.default_rng(5)
    y = np.array([int(i % every == 0) for i in range(9000)])
    x = rng.normal(0, 1, (9000, len(quality.NAMES))).astype(np.float32)
    x[:, 0] += y
    rows = spark.createDataFrame([(int(a), int(h), b.tolist()) for a, h, b in zip(y, rng.integers(0, 1 << 60, 9000), x, strict=True)],
                                 "_label int, _hash long, x array<float>").repartition(5)
    model = quality.fit(rows)
    assert np.allclose(model.mean, x.astype(float).mean(0), atol=1e-6) and np.allclose(model.scale, x.astype(float).std(0), atol=1e-6)
    s = np.sort(model.strength(x.astype(float)))
    zeros = int((y == 0).sum())
    assert np.isclose(model.cut, (s[zeros - 1] + s[zeros]) / 2)
    assert every > 3 or np.argmax(np.abs(model.weight)) == 0  # a few rows of a class may favour other inputs by chance
    d = model.strength(x.astype(float)) - model.cut

    def slope(k):
        return (d * (1 / (1 + np.exp(-np.clip(k * d, -30, 30))) - y)).sum() + 1e-3 * k

    assert model.slope == pytest.approx(0.05) or slope(model.slope * 0.99) < 0 < slope(model.slope * 1.01)
