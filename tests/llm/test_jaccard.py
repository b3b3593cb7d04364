import random
import re

import pytest

from pitlake.llm import jaccard


def brute(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    ids = [i for i, _ in rows]
    comp = dict(zip(ids, ids, strict=True))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = dict.fromkeys(ids, 0)
    for a in range(len(rows)):
        for b in range(a):
            if ids[a] == ids[b]:
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((root(ids[a]), root(ids[b])))
                comp[y] = x
    return sorted((i, len(s), root(i), links[i]) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ähre", "ÉTÉ", "x.y"]
    hot = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = (" " if rng.random() < 0.5 else "\n").join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 90])))
            if kind > 0.8:
                text += " " + hot
        if rng.random() < 0.2:
            text = text.upper()
        texts.append(text)
        rows.append((i * 3 - 50, text))
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 5, 80), (2, 5, 80), (3, 2, 50)])
def test_equals_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard.jaccard_join(df, width=width, percent=percent).collect())
    assert got == brute(rows, width, percent)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(120)] = f"u{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_join(df).collect()) == brute(rows)


@pytest.mark.parametrize("mixed", [False, True])
def test_long_chain_meets_few_blocks(spark, monkeypatch, mixed):
    """A chain of linked sets is one group; only blocks that share a key are scanned together."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    met = []
    plain = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda *a: met.append(plain(*a)) or met[-1])
    n, at = 400, list(range(400))
    if mixed:
        random.Random(6).shuffle(at)
    rows = [(at[i], " ".join(f"c{j}" for j in range(3 * i, 3 * i + 44))) for i in range(n)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.component_id for r in got} == {0}
    blocks, pairs = met[0]
    k = blocks.select("block").distinct().count()
    assert n / 16 <= k <= n / 4
    if not mixed:
        assert pairs.count() < 5 * k < k * (k + 1) / 2


def test_edges(spark):
    schema = "doc_id long, text string, component_id string, n long, _gone int, key int"
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (None, "one two"),
        (7, "one two three four five"), (7, "one two three four five"), (8, "x" * 300_000), (9, "a b c d e f g"),
    ]
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], schema)
    got = sorted(map(tuple, jaccard.jaccard_join(df).collect()), key=str)
    want = [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 1), (5, 1, 4, 1), (6, 1, 6, 1), (7, 1, 6, 1), (7, 1, 6, 1), (8, 1, 8, 0), (9, 3, 9, 0),
            (None, 1, None, 0)]
    assert got == sorted(want, key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 9, None], key=str)
    assert jaccard.jaccard_join(df.limit(0)).collect() == []


def test_repeated_key_with_other_texts_is_one_node(spark):
    a, b, c = "a b c d e f", "g h i j k l", "g h i j k l"
    rows = [(5, a), (3, a), (5, b), (9, c)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3)}


def test_subset_keys_and_lists_agree(spark):
    """Any boundary between enumeration and scanning gives the same links."""
    rows = corpus(7, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    keep = jaccard._boundary
    try:
        for at in (-1, 8, 99):
            jaccard._boundary = lambda sets, at=at: at
            assert sorted(tuple(r) for r in jaccard.jaccard_join(df).collect()) == want
    finally:
        jaccard._boundary = keep
