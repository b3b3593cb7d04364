import math
import random

from pitlake.llm import topk


def brute(rows, k=10, scale=1024):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(10)]) for i in range(330)]
    rows += [(400 + i, rows[5][1]) for i in range(20)]  # ties
    rows += [(600, None), (601, [None] * 10), (602, [float("nan")] * 10), (700, [float("inf")] * 10), (None, rows[0][1]), (603, [])]
    rows += [(800, [1.0, 2.0]), (801, [3.0, -1.0])]  # another length
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, id int").repartition(3)
    for block, group in ((8192, 1024), (40, 2)):
        got = topk.top_k(df, block=block, group=group)
        assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    q, x = rng.integers(-900, 900, (20, 64)), rng.integers(-900, 900, (50, 64))
    exact = q @ x.T
    before = None
    turn = topk._axes(x)
    assert np.allclose(turn.T @ turn, np.eye(64))
    for a, b in ((q, x), (q @ turn, x @ turn)):
        before = None
        for n in topk.LEVELS:
            top = topk._bound(topk._stats(a, n), topk._stats(b, n))
            assert (top >= exact - 1e-6).all()
            assert before is None or top.mean() < before
            before = top.mean()


def test_bounds_prune_clustered_vectors():
    """Vectors around centres in a few directions, mixed over all components: few pairs reach the exact product."""
    import numpy as np

    rng = np.random.default_rng(2)
    mixed = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    centres = rng.normal(size=(40, 64)) * (np.arange(64) < 6) @ mixed * 900
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 64)) * 20).astype(np.int64)
    ids, kept = np.arange(4000), []
    i, j, score = topk.search_block(x[:40], x, ids[:40], ids, 10, kept)
    exact = x[:40] @ x.T
    exact[np.arange(40), np.arange(40)] = -(2**62)
    for r in range(40):
        want = sorted((-exact[r, c], c) for c in range(4000))[:10]
        assert [(-s, c) for s, c in zip(score[i == r], j[i == r], strict=True)] == want
    assert kept[0] == 40 * 3999 and kept == sorted(kept, reverse=True)
    assert kept[-1] < kept[0] / 10


def test_huge_components_fail(spark):
    import pytest

    df = spark.createDataFrame([(100, [1e12, 0.0]), (1, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(df).collect()
