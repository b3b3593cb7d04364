import random
import re

import numpy as np

from pitlake.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, width=13, share=20):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            for k in range(max(1, len(p) - width + 1) if p else 0):
                g = p[k : k + width]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(str(item) if item is not None else "null")
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=str)


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "A1", "é", "straße", "zwei"] + [f"v{i}" for i in range(20)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for k in range(12)]
    items += [(3, "  "), (4, None), (None, items[5][1]), (0, items[0][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary + ["z", "y"]) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6:
            p = words(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(60, None), (61, ""), (None, items[4][1]), (7, docs[7][1]), (62, "x" * 200_000 + " " + items[5][1])], items


def test_equals_brute_force(spark):
    docs, items = data(1)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, digest int, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.contamination(df, bench)) == brute(docs, items)
    kept = D.clean(df, bench)
    bad = {(r[0], r[1]) for r in brute(docs, items) if r[4]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, t in docs if (d, len(words(t))) not in bad), key=str)
    assert kept.columns == df.columns


def test_blocks_of_items_give_the_same(spark):
    docs, items = data(2)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small = 500 / (1 << 20)
    assert rows(D.contamination(df, bench, block_mb=small)) == brute(docs, items)
    assert sorted(map(str, D.clean(df, bench, block_mb=small).collect())) == sorted(map(str, D.clean(df, bench).collect()))


def test_spans_are_code_points(spark):
    text = "ÄÖ Straße ü the quick one"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = D.contamination(df, spark.createDataFrame([(1, "the, QUICK")], "item_id long, text string")).first()
    assert [text[s.start : s.end] for s in got.spans] == ["the quick"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.contamination(docs, bench)) == [(1, 2, 0, (), False)]
    assert D.clean(docs, bench).count() == 1
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_index_against_plain_search():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, 400)
    s[-1] = 0
    index = D.FMIndex(s, 4)
    for size in (1, 2, 5):
        for _ in range(20):
            p = rng.integers(1, 4, (1, size))
            lo, hi = index.search(p, np.array([size]))
            want = [k for k in range(len(s) - size + 1) if (s[k : k + size] == p[0]).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_one_block_at_a_time_and_copies_joined_back(spark, monkeypatch):
    """Copies of one key and text, null ones too, are not merged together, and a block is made after the last one is landed."""
    docs, items = data(3)
    hit = next(d for d in docs if any(r[0] == d[0] and r[2] for r in brute([d], items)))
    docs += [(None, None)] * 300 + [hit] * 200
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items * 20, "item_id long, text string")
    steps, made, landed = [], D.Phrases.__init__, D.land
    monkeypatch.setattr(D.Phrases, "__init__", lambda self, *a: (steps.append("block"), made(self, *a))[1])
    monkeypatch.setattr(D, "land", lambda df, name: (steps.append(name), landed(df, name))[1])
    got = rows(D.contamination(df, bench, block_mb=150 / (1 << 20)))
    once = brute([d for d in dict.fromkeys(docs)], items)
    times = {k: docs.count(k) for k in set(docs)}
    assert got == sorted([r for d in times for r in brute([d], items) * times[d]], key=str) and len(once) == len(times)
    assert steps[:5] == ["block", "scanned", "hits", "block", "hits"] and steps.count("block") == steps.count("hits") < 12
