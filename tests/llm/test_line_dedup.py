import random

import pytest

from pitlake.llm import line_dedup


def brute(rows, least):
    """Every line of every later copy of a run of at least `least` words, by comparing all starts."""
    docs = sorted(rows)
    seq = []
    for i, text in docs:
        seq.append((i, [(n, x, len(x.split())) for n, x in enumerate(text.split("\n")) if x.split()]))
    gone = {i: set() for i, _ in docs}
    for p, (d, a) in enumerate(seq):
        for q in range(p + 1):
            b = seq[q][1]
            for s in range(len(a)):
                for t in range(len(b) if q < p else s):
                    m = 0
                    while s + m < len(a) and t + m < len(b) and a[s + m][1] == b[t + m][1]:
                        m += 1
                    if sum(x[2] for x in a[s : s + m]) >= least:
                        gone[d] |= {x[0] for x in a[s : s + m]}
    return sorted((i, text.count("\n") + 1, len(gone[i]), "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i])) for i, text in docs)


@pytest.mark.parametrize("seed,least", [(1, 6), (2, 9), (3, 1), (4, 50)])
def test_equals_brute_force(spark, seed, least):
    rng = random.Random(seed)
    lines = ["a b c", "d", "e f", "g h i j k", "", "  ", "m n", "Über ç"] + [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([2, 20, 60]))) for _ in range(5)]
    rows = []
    for i in range(40):
        body = [rng.choice(lines) if rng.random() < 0.9 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 25))]
        if rows and rng.random() < 0.3:
            body += rng.choice(rows)[1].split("\n")
        rows.append((i * 2, "\n".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df, min_words=least)
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == brute(rows, least)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"{long}\nend"), (5, f"start\n{long}"), (None, long), (6, "tail"), (7, "p q r s\nT"), (7, "p q r s\nT")]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "doc_id long, text string, d int, _at string, n_lines int")
    got = line_dedup.dedup_lines(df, min_words=3)
    assert got.columns == ["doc_id", "text", "d", "_at", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == sorted([
        (1, 0, 0, None), (2, 1, 0, ""), (3, 3, 0, "\n\n"), (4, 2, 1, "end"), (5, 2, 1, "start"), (None, 1, 0, long), (6, 1, 0, "tail"),
        (7, 2, 0, "p q r s\nT"), (7, 2, 0, "p q r s\nT")], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df, min_words=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
