"""Token counts by trie-shared dynamic programming under a unigram vocabulary.

A text's pre-tokens are its runs without white space, each with the word mark in front. Each task puts its
distinct new pre-tokens into a trie and walks it level by level: a node's forward score is the best way to
cut its prefix into pieces, so words that share a prefix share the work, and the node where a pre-token
ends gives its count. A worker remembers the counts of pre-tokens it has met.

Pieces come from a public piece vocabulary in its own order. That file ranks merges and has no unigram
probabilities, so a piece of rank r gets Zipf's -ln(r + 2); a byte that no piece covers costs BYTE. Costs are
integers (millionths, with the number of pieces as the last digits), so the best cut is exact, and of equally
likely cuts the one with fewer pieces wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.words import CLASSES, U64, bounds, hashes, texts

MARK = "▁".encode()
BYTE = -2 * math.log(32_000)
_LONG = 256  # bytes of a pre-token beyond which it is cut on its own
_MOST_WORDS = 1 << 21


def cost(score: float) -> int:
    """One piece's integer score: more is better."""
    return round(score * 1_000_000) * 1024 - 1


class Pieces:
    """Vocabulary trie as sorted (state * 256 + byte) edges; gain of the piece that ends in a state, or none."""

    def __init__(self, pieces: list[tuple[bytes, int]], byte: int):
        self.byte, self.gain_of = byte, dict(pieces)
        edges: dict[int, int] = {}
        gain = {}
        for piece, value in pieces:
            state = 0
            for b in piece:
                state = edges.setdefault(state * 256 + b, len(edges) + 1)
            gain[state] = value
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.none = np.iinfo(np.int64).min // 4
        self.gain = np.full(len(edges) + 1, self.none, np.int64)
        for state, value in gain.items():
            self.gain[state] = value
        self.longest = max((len(p) for p, _ in pieces), default=1)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state, or -1."""
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        real = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        return cls([(p.id_to_piece(i).encode(), cost(-math.log(r + 2))) for r, i in enumerate(real)], cost(BYTE))


def count_one(word: bytes, pieces: Pieces) -> int:
    """Pieces of one pre-token, position by position."""
    best, count = [0], [0]
    for end in range(1, len(word) + 1):
        top, n = best[-1] + pieces.byte, count[-1] + 1
        for start in range(max(0, end - pieces.longest), end):
            gain = pieces.gain_of.get(word[start:end])
            if gain is not None and best[start] + gain > top:
                top, n = best[start] + gain, count[start] + 1
        best.append(top), count.append(n)
    return count[-1]


def count_trie(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Pieces of each of many pre-tokens of at most _LONG bytes, one trie level at a time."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    out = np.zeros(len(words), np.int64)
    node = np.zeros(len(words), np.int64)  # each word's node on this level
    live = np.flatnonzero(size > 0)
    # What has been begun at each node or above it: node, vocabulary state, score and pieces at its beginning.
    begun, state, base, pieces_at = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    score, count = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(int(size.max(initial=0))):
        key, place = np.unique(node[live] * 256 + data[first[live] + depth], return_inverse=True)
        node[live] = place
        parent, byte = key >> 8, key & 255
        start = np.searchsorted(begun, parent)
        n = np.searchsorted(begun, parent, "right") - start
        take = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(key)), n)
        to = pieces.step(state[take], byte[owner])
        on = to >= 0
        begun, state, base, pieces_at = owner[on], to[on], base[take[on]], pieces_at[take[on]]
        new, new_count = score[parent] + pieces.byte, count[parent] + 1
        total = base + pieces.gain[state]
        full = np.flatnonzero(pieces.gain[state] > pieces.none)
        if len(full):
            order = full[np.lexsort((total[full], begun[full]))]
            last = np.append(begun[order][1:] != begun[order][:-1], True)
            best = order[last]
            better = best[total[best] > new[begun[best]]]
            new[begun[better]], new_count[begun[better]] = total[better], pieces_at[better] + 1
        score, count = new, new_count
        done = live[size[live] == depth + 1]
        out[done] = count[node[done]]
        live = live[size[live] > depth + 1]
        fresh = np.arange(len(key))
        order = np.argsort(np.concatenate([begun, fresh]), kind="stable")
        begun = np.concatenate([begun, fresh])[order]
        state = np.concatenate([state, np.zeros(len(key), np.int64)])[order]
        base = np.concatenate([base, score])[order]
        pieces_at = np.concatenate([pieces_at, count])[order]
    return out


class Counter:
    """Counts of pre-tokens, remembered by hash."""

    def __init__(self, path: str):
        self.pieces = Pieces.load(path)
        self.known, self.count = np.zeros(0, U64), np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and pieces of each row of a run of rows."""
        start, end = bounds(CLASSES["space"][data], offsets)
        value, seen, place = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > _MOST_WORDS:
            self.known, self.count = self.known[:0], self.count[:0]
        there = np.isin(value, self.known, assume_unique=True)
        new = np.flatnonzero(~there)
        if len(new):
            raw = data.tobytes()
            words = [MARK + raw[start[k] : end[k]] for k in seen[new]]
            long = np.array([len(w) > _LONG for w in words])
            counts = np.zeros(len(words), np.int64)
            counts[~long] = count_trie([w for w in words if len(w) <= _LONG], self.pieces)
            counts[long] = [count_one(w, self.pieces) for w in words if len(w) > _LONG]
            known = np.concatenate([self.known, value[new]])
            order = np.argsort(known)
            self.known, self.count = known[order], np.concatenate([self.count, counts])[order]
        each = self.count[np.searchsorted(self.known, value)][place] if len(value) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        cuts = np.searchsorted(start, offsets)
        return np.diff(cuts), np.diff(total[cuts])


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_pretokens, n_tokens.

    Null, empty and blank texts have none. Bytes outside the vocabulary are one token each. Null keys and
    repeated rows are counted like any other; extra columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            words, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b, data, offsets in texts(batch.column(1)):
                words[a:b], tokens[a:b] = counter.rows(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=[key, "n_pretokens", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_tokens long")
