import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitlake.llm import packing
from pitlake.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
TEXTS = [
    None, "", " \n", "It's the dog's, we'll see", "İstanbul ﬁ", "áb", "<|endoftext|> x", "12 34,5!! ...abc", "x×y ÷ Àß ÉÉ", "日本 ab12",
    "Ünï co\x85de", "a\x1cb", "word " * 9000, "z" * 30_000, "THE the The", "naïve façade", "Σας ΣΑΣ",
]


def check(rows, texts, size):
    tokenizer = packing.Encoder(PATH).tokenizer
    want = Counter()
    for key, text in texts:
        raw = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(raw), size):
            part = raw[k : k + size]
            want[(key, k // size, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    return len(filled), sum(r.length for r in rows)


def test_pieces_and_places(spark):
    texts = [*enumerate(TEXTS), (None, "null key"), (3, TEXTS[3])]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, length int, rank int").repartition(2)
    for size in (2048, 16):
        n, total = check(packing.pack(df, PATH, size=size).collect(), texts, size)
        assert n >= -(-total // size)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_copies_of_one_row_are_numbered_in_many_tasks(spark, monkeypatch):
    landed = {}

    def keep(df, name):
        landed[name] = land(df, name)
        return landed[name]

    land = packing.land
    monkeypatch.setattr(packing, "land", keep)
    n, salt = 100_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(n).selectExpr("7L as doc_id", "'one line of text' as text")
    rows = packing.pack(df, PATH)
    groups = [r.n for r in landed["lengths"].collect()]
    assert len(groups) == salt and max(groups) < 1.1 * n / salt
    length = rows.first().length
    assert rows.groupBy("sequence_id").agg({"*": "count"}).count() == -(-n // (2048 // length))
    assert rows.select("sequence_id", "offset").distinct().count() == n


def simple_best_fit(lengths, size):
    room = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= length]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - length)
        else:
            room.append(size - length)
    return len(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 64])
    counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
    filled, got = defaultdict(list), Counter()
    for length, lo, hi, first, per, at in packing.plan(counts, size):
        for x in range(lo, hi):
            filled[first + (x - lo) // per].append((at + (x - lo) % per * length, length))
            got[length] += 1
    assert got == counts
    for own in filled.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    assert len(filled) == simple_best_fit([k for k, n in counts.items() for _ in range(n)], size)
    assert packing.plan({}, size) == []
