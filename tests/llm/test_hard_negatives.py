import math
import random

import numpy as np
import pytest

from pitlake.llm import hard_negatives as hn


def brute(rows, scale=256, every=100, flip=7, low=30, high=90):
    ok = [(i, (c + 1) % 10 if flip and i % flip == 0 else c, [math.floor(scale * float(x)) for x in v]) for i, v, c in rows
          if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, *_ in ok if i % every == 0}):
        _, label, a = min((i, c, x) for i, c, x in ok if i == q)
        score = [(-sum(x * y for x, y in zip(a, b, strict=True)), i, c) for i, c, b in ok if len(a) == len(b)]
        for s, i, _ in sorted(t for t in score if t[2] == label and t[1] != q)[:5]:
            near = sorted((t, j) for t, j, c in score if c != label and low * -s <= 100 * -t <= high * -s)[:10]
            out += [(q, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(near)]
    return sorted(out)


SHAPE = "vec_id long, embedding array<double>, label int, rank int, id int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SHAPE)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    rows = []
    for i in range(500):
        c = centre[rng.randrange(4)]
        rows.append((i, [x + rng.gauss(0, 0.7) for x in c], rng.choice([0, 0, 0, 3, 5, 9])))
    rows += [(1000 + i, rows[11][1], i % 3) for i in range(40)]  # ties of the same and of other labels
    rows += [rows[12]] * 3 + [(5000, rows[13][1], 2), (5000, rows[14][1], 1)]  # repeated rows, a key twice
    rows += [(600, None, 1), (700, [None] * 20, 1), (800, rows[1][1], None), (900, [math.nan] * 20, 1), (2100, [math.inf] * 20, 1), (None, rows[1][1], 1), (2200, [], 1)]
    rows += [(2300, [1.0, 2.0], 0), (2301, [3.0, 1.0], 0), (2302, [2.0, 1.0], 4)]  # another length
    rows += [(2400, [-x for x in rows[0][1]], 8), (2401, rows[0][1], 8)]  # a negative positive score
    want = brute(rows)
    assert any(r[0] == 2300 for r in want) and not any(r[0] == 2400 for r in want)
    df = frame(spark, rows).repartition(3)
    for group in (8192, 2):
        assert sorted(map(tuple, hn.hard_negatives(df, group=group).collect())) == want
    assert sorted(map(tuple, hn.hard_negatives(df, every=50, flip=0, scale=64, low=10, high=100).collect())) == brute(rows, 64, 50, 0, 10, 100)


def test_nothing_to_search(spark):
    df = frame(spark, [(1, [1.0], 1)])
    assert hn.hard_negatives(df.limit(0)).collect() == [] == hn.hard_negatives(df).collect()


def test_too_large_products_fail(spark):
    from pyspark.errors import PySparkException

    for rows in ([(0, [1e30], 1), (1, [1.0], 1)], [(0, [1e13], 1), (1, [1e13], 1)]):
        with pytest.raises(PySparkException, match="64 bits"):
            hn.hard_negatives(frame(spark, rows), flip=0).collect()


def test_scan_narrows_and_stays_exact():
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 300, (10, 64))
    labels = rng.integers(0, 10, 4000)
    x = (centre[labels] * (rng.random((4000, 64)) < 0.3) + rng.normal(0, 30, (4000, 64))).astype(np.int64)
    block = hn.Block(np.arange(4000), labels, x.T)
    best = hn.Best(5)
    seen = hn.positives_in(block, x[0], 0, int(labels[0]), best)
    score = x @ x[0]
    own = np.flatnonzero((labels == labels[0]) & (np.arange(4000) != 0))
    assert best.id.tolist() == own[np.lexsort((own, -score[own]))[:5]].tolist()
    assert seen == sorted(seen, reverse=True) and seen[len(seen) // 2] < seen[0] / 4
    top = int(best.score[0])
    found = [hn.Best(10)]
    hn.negatives_in(block, x[0], int(labels[0]), [(30 * top // 100, 90 * top // 100)], found)
    rest = np.flatnonzero((labels != labels[0]) & (score >= 30 * top // 100) & (score <= 90 * top // 100))
    assert found[0].id.tolist() == rest[np.lexsort((rest, -score[rest]))[:10]].tolist()
