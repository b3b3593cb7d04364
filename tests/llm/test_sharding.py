import random
import zlib

import pytest
import xxhash

from pitlake.llm import sharding


def text_hash(text):
    return xxhash.xxh64_intdigest((text or "").encode(), seed=42) >> 1


def check(rows, got, shards, tolerance):
    """rows: (doc_id, text); got: rows of `shard`. Everything the law says, by sorting in plain Python."""
    size = {(i, t): len((t or "").encode()) + 1 for i, t in rows}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size[i, t], zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    total = sum(r.size for r in got)
    allowed = tolerance * total / shards
    sums = [sum(r.size for r in got if r.shard <= s) for s in range(shards)]
    assert sums[-1] == total
    groups = {}
    for i, t in rows:
        groups[text_hash(t)] = groups.get(text_hash(t), 0) + size[i, t]
    edges, at = [0], 0
    for h in sorted(groups):
        at += groups[h]
        edges.append(at)
    biggest = max((r.size for r in got), default=0)
    parted = 0
    crc_hash = {zlib.crc32((t or "").encode()): text_hash(t) for _, t in rows}
    for s in range(shards - 1):
        target = total * (s + 1) // shards
        assert abs(sums[s] - target) <= max(allowed, biggest / 2 + 1)
        left = {crc_hash[r.text_crc32] for r in got if r.shard <= s}
        right = {crc_hash[r.text_crc32] for r in got if r.shard > s}
        assert not left or not right or max(left) <= min(right)  # a range of the sort key
        if left & right:
            parted += 1
            assert min(abs(e - target) for e in edges) > allowed
    return parted


def run(spark, rows, shards=16, tolerance=0.005, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, size int, shard int, _h string").repartition(parts)
    return check(rows, sharding.shard(df, shards, tolerance=tolerance).collect(), shards, tolerance)


def words(rng, n):
    return " ".join(rng.choice(["é", "bb", "ccc", "dddd"]) for _ in range(n))


def test_hot_groups_and_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(700)]
    rows += [(1000 + i, "one text " * 12) for i in range(400)]  # a third of all bytes
    rows += [(3000, "the same row " * 4)] * 300  # equal in key and text
    rows += [(4000 + i, None) for i in range(9)] + [(5000 + i, "") for i in range(9)] + [(None, "no key"), (None, None)]
    assert run(spark, rows) >= 4
    run(spark, rows + [(9000, "x" * 200_000)])
    assert run(spark, rows, shards=3, tolerance=0.0) >= 1


def test_small_groups_stay_whole(spark):
    rng = random.Random(2)
    rows = [(i, f"{i // 4} " + "w" * 40) for i in range(4000)]
    assert run(spark, rows, shards=4) == 0
    rng.shuffle(rows)
    assert run(spark, rows, shards=4) == 0


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, None)] * 5, [(i, "same") for i in range(40)]])
def test_tiny_tables(spark, rows):
    run(spark, rows)


def test_pieces_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 10)
    rng = random.Random(4)
    rows = [(i, words(rng, 9)) for i in range(900)]
    run(spark, rows, shards=4)
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows], "doc_id long, text string, note string, shard int")
    out = sharding.write_shards(df, str(tmp_path / "shards"), shards=4)
    assert out.columns == ["doc_id", "text", "note", "slot", "shard"]
    got = out.collect()
    assert sorted((r.doc_id, r.text, r.note) for r in got) == sorted((i, t, "kept") for i, t in rows)
    want = {(r.doc_id, r.shard) for r in sharding.shard(df, shards=4).collect()}
    assert {(r.doc_id, r.shard) for r in got} == want
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_native(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    plan = sharding.shard(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
