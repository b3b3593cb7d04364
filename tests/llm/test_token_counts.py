import re

from pitlake.llm import token_counts as T
from pitlake.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def best_cut(word, gain, byte, longest):
    """Fewest-cost cut by recursion from the right end, without tries or shared work."""
    best = {0: (0, 0)}
    for end in range(1, len(word) + 1):
        ways = [(best[end - 1][0] + byte, best[end - 1][1] - 1)]
        for start in range(max(0, end - longest), end):
            if word[start:end] in gain:
                ways.append((best[start][0] + gain[word[start:end]], best[start][1] - 1))
        best[end] = max(ways)
    return -best[len(word)][1]


def test_equals_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "the theory of theories, then there"), (5, "日本語 テスト émeute"), (6, "x" * 700 + " ab"),
            (None, "null key"), (4, "the theory of theories, then there"), (7, "\x00\x01 ü"), (8, "abcabcabc " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(2)
    pieces = T.Pieces.load(PATH)
    want = []
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        memo = {w: best_cut(T.MARK + w, pieces.gain_of, pieces.byte, pieces.longest) for w in set(words)}
        want.append((i, len(words), sum(memo[w] for w in words)))
    got = T.token_counts(df, PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert T.token_counts(df.limit(0), PATH).collect() == []


def test_small_vocabulary():
    pieces = T.Pieces([(b"a", T.cost(-3)), (b"ab", T.cost(-2)), (b"b", T.cost(-1)), (b"aba", T.cost(-9))], T.cost(-20))
    words = [b"a", b"ab", b"aba", b"abab", b"c", b"", b"abc"]
    assert T.count_trie(words, pieces).tolist() == [1, 1, 2, 2, 1, 0, 2]
    assert [T.count_one(w, pieces) for w in words] == [1, 1, 2, 2, 1, 0, 2]
