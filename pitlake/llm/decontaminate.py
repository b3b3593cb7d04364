"""Benchmark decontamination by an FM-index per shard of the training texts.

A test phrase is 13 consecutive words of an item (the whole item, if it has fewer). Every task indexes
the words of its own shard: suffix array, Burrows-Wheeler transform, wavelet tree ranks and sampled
suffix positions. All phrases are searched backwards at once, occurrences are located through the
samples, and overlapping occurrences merge into removal spans. Nothing is shuffled: a shard's texts
stay where they were read, and hot passages only lengthen that shard's own list of occurrences.

Words that no item has cannot be part of an occurrence, so a shard's index holds only the stretches of
phrase vocabulary that are at least as long as the shortest phrase; a sentinel stands between stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.llm.words import texts, words

SAMPLE = 8
_SHARD = 1 << 21  # bytes of text in one index, or one longer document


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; s must end in a unique least symbol."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, step = len(s), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Ranks of a symbol sequence, one bit level after the other (most significant first)."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (s >> bit) & 1
            before = np.zeros(len(s) + 1, np.int32)
            np.cumsum(1 - ones, out=before[1:])
            self.levels.append((bit, before, int(before[-1])))
            s = np.concatenate([s[ones == 0], s[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo = np.zeros(len(at), np.int64)
        hi = at.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = before[lo], before[hi]
            lo = np.where(one, zeros + lo - a, a)
            hi = np.where(one, zeros + hi - b, b)
        return hi - lo


class FMIndex:
    """Backward search and locate over a sequence of symbols >= 1, where 0 separates stretches."""

    def __init__(self, s: np.ndarray, symbols: int):
        n, gaps = len(s), np.flatnonzero(s == 0)
        own = s.astype(np.int64) + len(gaps)
        own[gaps] = np.arange(len(gaps))[::-1]  # separators differ, so no match runs across one
        sa = suffix_array(own)
        bwt = s[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.tree, self.bwt = WaveletTree(bwt, symbols), bwt
        self.marked = (sa % SAMPLE == 0) | (bwt == 0)  # so no walk crosses a separator
        self.position = np.where(self.marked, sa, -1)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (rows padded on the left; length symbols at the right end)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        width = phrases.shape[1]
        for k in range(width):
            at = np.flatnonzero((lo < hi) & (length > k))
            if not len(at):
                break
            c = phrases[at, width - 1 - k]
            base = self.start[c]
            lo[at], hi[at] = base + self.tree.rank(c, lo[at]), base + self.tree.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(at := np.flatnonzero(~self.marked[rows])):
            c = self.bwt[rows[at]]
            rows[at] = self.start[c] + self.tree.rank(c, rows[at])
            steps[at] += 1
        return self.position[rows] + steps


class Phrases:
    """Distinct test phrases over the vocabulary of a block of items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        column = pa.array([t for _, t in items], pa.string())
        own, window = [], {}
        for a, b, data, offsets in texts(column):
            w = words(data, offsets, "alnum")
            own += [w.hash[w.first[r] : w.first[r + 1]] for r in range(b - a)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        for (item, _), hashes in zip(items, own, strict=True):
            ids = (np.searchsorted(self.vocabulary, hashes) + 1).tolist()
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                window.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.length = np.array([len(k) for k in window], np.int64)
        self.symbols = np.zeros((len(window), width), np.int64)
        for i, k in enumerate(window):
            self.symbols[i, width - len(k) :] = k
        self.items = [sorted(v) for v in window.values()]
        self.shortest = int(self.length.min()) if len(window) else 0
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def scan(column: pa.Array, phrases: Phrases):
    """Per row of a batch: words, hit words, sorted item ids, merged spans in code points."""
    for a, b, data, offsets in texts(column, _SHARD):
        w = words(data, offsets, "alnum")
        rows = b - a
        count = np.diff(w.first)
        items: list[set] = [set() for _ in range(rows)]
        hit = np.zeros(len(w.hash) + 1, np.int64)
        symbol = phrases.symbols_of(w.hash) if len(phrases.length) else np.zeros(0, np.int64)
        # Stretches of vocabulary inside one row that can hold a phrase.
        inside = symbol > 0
        begin, end = inside.copy(), inside.copy()
        if len(inside):
            begin[1:] &= ~inside[:-1] | (w.row[1:] != w.row[:-1])
            end[:-1] &= ~inside[1:] | (w.row[1:] != w.row[:-1])
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = end - begin >= max(1, phrases.shortest)
        begin, end = begin[long], end[long]
        if len(begin):
            size = end - begin + 1
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            s = np.zeros(len(at), np.int64)
            body = np.ones(len(at), bool)
            body[np.cumsum(size) - 1] = False
            s[body] = symbol[at[body]]
            index = FMIndex(s, len(phrases.vocabulary) + 1)
            lo, hi = index.search(phrases.symbols, phrases.length)
            found = np.flatnonzero(lo < hi)
            times = (hi - lo)[found]
            which = np.repeat(found, times)
            row_range = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            first = at[index.locate(row_range)] if len(which) else which
            np.add.at(hit, first, 1)
            np.add.at(hit, first + phrases.length[which], -1)
            for r, p in set(zip(w.row[first].tolist(), which.tolist(), strict=True)):
                items[r].update(phrases.items[p])
        hit = np.cumsum(hit)[:-1] > 0
        n_hit = np.bincount(w.row[hit], minlength=rows)
        for r in range(rows):
            spans = []
            if n_hit[r]:
                own = hit[w.first[r] : w.first[r + 1]]
                edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                starts = w.start[w.first[r] + np.flatnonzero(edge == 1)]
                ends = w.end[w.first[r] + np.flatnonzero(edge == -1) - 1]
                chars = np.concatenate([[0], np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
                spans = [
                    {"word": int(k), "words": int(m - k), "start": int(chars[x - offsets[r]]), "end": int(chars[y - offsets[r]])}
                    for k, m, x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), starts, ends, strict=True)
                ]
            yield int(count[r]), int(n_hit[r]), sorted(items[r]), spans


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, block_mb: float) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of a bounded size the items make, usually one, and the phrases of one block after the other."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")

    def blocks_of(rows: DataFrame) -> int:
        return 1 + int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (block_mb * (1 << 20)))

    blocks = blocks_of(items)
    if blocks > 1:  # copies of an item would all come to its block
        items = items.distinct()
        blocks = blocks_of(items)

    def phrases():
        for k in range(blocks):
            own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
            yield Phrases([(r.item if r.item is not None else "null", r.text) for r in own.collect()], width)

    return blocks, phrases()


_SPANS = "array<struct<word:int,words:int,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([(x, pa.int32()) for x in ("word", "words", "start", "end")]))


def _scanned(docs: DataFrame, key: str, text: str, phrases: Phrases) -> DataFrame:
    def run(batches):
        for batch in batches:
            cols = list(zip(*scan(batch.column(1), phrases))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], _SPAN)],
                names=[key, "digest", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text"), F.md5(F.col(text).cast("binary")).alias("digest")).mapInArrow(
        run, f"`{key}` {kind}, digest string, n_words long, n_hit long, items array<string>, spans {_SPANS}")


def _merged(table: pa.Table) -> pa.Table:
    """Rows of one document and text, one from each block with hits -> one row."""
    rows, first = table.to_pylist(), None
    out: list[dict] = []
    for s in sorted((s for r in rows for s in r["spans"]), key=lambda s: s["word"]):
        if first is not None and s["word"] <= first["word"] + first["words"]:
            if s["word"] + s["words"] > first["word"] + first["words"]:
                first |= {"words": s["word"] + s["words"] - first["word"], "end": s["end"]}
        else:
            first = dict(s)
            out.append(first)
    one = rows[0] | {"spans": out, "n_hit": sum(s["words"] for s in out), "items": sorted({i for r in rows for i in r["items"]})}
    return pa.Table.from_pylist([one], schema=table.schema)


def _of_blocks(docs: DataFrame, key: str, text: str, blocks: Iterator[Phrases]) -> DataFrame:
    """The rows of _scanned, merged over blocks. One block is held and searched at a time: its hits are landed, one
    row per document and text, and the merged ones are joined back to all copies."""
    columns, parts, rest = [key, "digest", "n_words", "n_hit", "items", "spans"], [], None
    for phrases in blocks:
        found = _scanned(docs, key, text, phrases)
        if rest is None:
            found = land(found, "scanned")
            rest = found.select(key, "digest", "n_words")
        one = F.first(F.struct("n_words", "n_hit", "items", "spans")).alias("_one")
        parts.append(land(found.where("n_hit > 0").groupBy(key, "digest").agg(one).select(key, "digest", "_one.*"), "hits"))
    hits = reduce(DataFrame.unionByName, parts)
    hits = hits.groupBy(key, "digest").applyInArrow(_merged, hits.schema).select(
        F.col(key).alias("_key"), F.col("digest").alias("_digest"), "n_hit", "items", "spans")
    same = rest[key].eqNullSafe(hits["_key"]) & rest["digest"].eqNullSafe(hits["_digest"])
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast(_SPANS)}
    return rest.join(hits, same, "left").select(*(F.coalesce(c, none[c]).alias(c) if c in none else rest[c] for c in columns))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", width: int = 13, share: int = 20, block_mb: float = 16) -> DataFrame:
    """One row per document: key, digest (md5 of the text), n_words, n_hit, items, spans, contaminated.

    A word inside any occurrence of a test phrase is hit; contaminated: n_hit > 0 and share * n_hit >= n_words.
    items: ids (as text, a null id reads "null"), sorted, of the items with occurrences. spans: merged hit words
    (first word, words) with their code points, end exclusive. A null or empty text has no words and is clean;
    items without words have no phrases; repeated items count once; null keys and repeated rows are returned
    like any other. An empty benchmark leaves every document clean. Extra columns are ignored. The benchmark is
    searched in blocks of block_mb of text, each in one pass; the hits of several blocks are landed one block after
    the other, merged per document and text and joined back to its copies.
    """
    count, blocks = _blocks(benchmark, item, item_text, width, block_mb)
    found = _of_blocks(docs, key, text, blocks) if count > 1 else _scanned(docs, key, text, next(blocks))
    return found.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, share: int = 20,
          block_mb: float = 16) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With one block of phrases, rows are dropped in the tasks that read them, without a shuffle.
    """
    count, blocks = _blocks(benchmark, "item_id", "text", width, block_mb)
    if count > 1:
        bad = contamination(docs, benchmark, key, text, "item_id", "text", width, share, block_mb).where("contaminated")
        bad = bad.select(F.col(key).alias("_key"), F.col("digest").alias("_digest")).distinct()
        same = docs[key].eqNullSafe(bad["_key"]) & F.md5(docs[text].cast("binary")).eqNullSafe(bad["_digest"])
        return docs.join(bad, same, "left_anti")
    place, phrases = docs.columns.index(text), next(blocks)

    def run(batches):
        for batch in batches:
            keep = [not (h and share * h >= n) for n, h, _, _ in scan(batch.column(place), phrases)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
