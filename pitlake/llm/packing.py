"""Best-fit packing planned over the histogram of lengths.

Whole texts become token ids (a public word-level BPE vocabulary) with a closing 0, and texts longer than a
sequence are cut into pieces. Only the counts per length, at most one row per length, come to the driver.
There best-fit runs over counts: a step gives all equal pieces to all equally filled sequences at once. The
pieces then take their planned places by a join on their rank within their length.

A pre-token's ids do not depend on its neighbours, so each task asks the tokenizer once per distinct
pre-token; texts with characters outside the plain classes below go through the tokenizer whole.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.llm.words import LOWER, U64, hashes, texts

_MOST_WORDS = 1 << 21  # distinct pre-tokens a worker remembers before it starts afresh
#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other; 4 sends the whole text to the tokenizer.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_CLASS[48:58] = 2
_CLASS[:9] = _CLASS[14:32] = _CLASS[[39, 127]] = _CLASS[0xC0:0xC3] = _CLASS[0xC4:] = 4


class Encoder:
    """Ids of whole texts by a tokenizer file; equal to its encode() of each text without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self):
        self.known, self.first, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, values: np.ndarray, tokens: list[str]):
        ids = np.array(self.tokenizer.encode(" ".join(tokens), add_special_tokens=False).ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(tokens):  # some token is no pre-token of its own
            each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in tokens]
            ids, stop = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
        first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        if len(self.known) > _MOST_WORDS:
            self._forget()
        known = np.concatenate([self.known, values])
        order = np.argsort(known)
        self.first = np.concatenate([self.first, first + len(self.flat)])[order]
        self.size = np.concatenate([self.size, stop - first])[order]
        self.known, self.flat = known[order], np.concatenate([self.flat, ids])

    def _lookup(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        return at, self.known[at] == values

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """The ids of each row of a run of rows."""
        low = LOWER[data]
        after = np.zeros(len(low), bool)
        after[1:] = data[:-1] == 0xC3
        kind = _CLASS[data]
        kind[after & ((data == 0x97) | (data == 0xB7))] = 4
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = 4  # may begin a special token
        low[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kind == 4), "right") - 1] = True
        starts = kind > 0
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cuts = offsets[:-1][offsets[:-1] < len(kind)]
        starts[cuts] = kind[cuts] > 0
        ends = kind > 0
        ends[:-1] &= starts[1:] | (kind[1:] == 0)
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        plain = ~odd[row]
        start, end, row = start[plain], end[plain], row[plain]
        value, place = np.unique(hashes(low, start, end), return_inverse=True)
        at, there = self._lookup(value)
        if not there.all():
            seen = np.zeros(len(value), np.int64)
            seen[place[::-1]] = np.arange(len(place))[::-1]
            raw, new = low.tobytes(), np.flatnonzero(~there)
            if len(self.known) > _MOST_WORDS:
                new = np.arange(len(value))
            self._learn(value[new], [raw[start[k] : end[k]].decode() for k in seen[new]])
            at, there = self._lookup(value)
        size = self.size[at][place] if len(value) else np.zeros(0, np.int64)
        first = self.first[at][place] if len(value) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        bounds = total[np.searchsorted(row, np.arange(len(offsets)))]
        for r in range(len(offsets) - 1):
            if odd[r]:
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[bounds[r] : bounds[r + 1]]


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids with a closing 0, cut at size tokens."""

    def run(batches):
        encoder = _ENCODERS.setdefault(path, Encoder(path)) if path not in _ENCODERS else _ENCODERS[path]
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for a, _, data, offsets in texts(batch.column(1)):
                for r, ids in enumerate(encoder.rows(data, offsets)):
                    raw = np.append(ids, 0).astype("<u4")
                    for k in range(0, len(raw), size):
                        part = raw[k : k + size]
                        owner.append(a + r), piece.append(k // size), start.append(k), length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit, longest first, over counts -> (length, first rank, end rank, first sequence, per sequence, offset).

    The piece of rank x in its length goes to sequence first + (x - rank) div per, and there to offset +
    ((x - rank) mod per) * length. Equally filled sequences move together, so the plan has about as many
    rows as there are lengths, however many pieces there are.
    """
    rows, used = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    rooms: list[int] = []

    def put(room: int, first: int, n: int):
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, n = size, used, -(-left // (size // length))
                used += n
            per = min(room // length, left)
            full = min(n, left // per)
            rows.append((length, rank, rank + full * per, first, per, size - room))
            put(room - per * length, first, full)
            put(room, first + full, n - full)
            rank, left = rank + full * per, left - full * per
    return rows


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing 0 alone. Null keys and repeated rows are packed like any other;
    extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    salt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A piece's place in the landed table, not its content, says where it is numbered: copies spread like others.
    cut = land(pieces(docs, path, key, text, size).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salt)))
    parts = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    parts = land(parts, "lengths")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(counts, size), "length long, lo long, hi long, seq long, per long, at long")
    before = parts.withColumn("before", F.expr("sum(n) over (partition by length order by _salt) - n")).drop("n")
    ranked = cut.join(before, ["length", "_salt"]).withColumn(
        "rank", F.expr(f"before + row_number() over (partition by length, _salt order by _row) - 1"))
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    step = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(slots), ["length"]).where(inside).select(
        key, "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"))
