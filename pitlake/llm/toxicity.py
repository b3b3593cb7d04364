"""Toxicity by a subword-bag model: n-gram vectors averaged into a linear softmax, trained jointly in numpy.

Every whole text is the bag of its byte n-grams (3 to 5 long, inside a word and its borders, A-Z lowered),
hashed into a fixed number of vectors. A misspelt word shares most n-grams with the word it disguises.
Training sees a bounded, documented sample of labelled rows; scoring is one pass over all texts, where a
vector counts only by its share of the class margin, so a bucket is one number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.words import CLASSES, LOWER, bounds, hashes, texts

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIM = 8
TEXTS = 4  # different texts of one sampled key that a fit sees
BLANK = 200  # zero vectors that every average also counts, so a few chance n-grams don't decide a short text


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket of every n-gram, where each row's n-grams begin and end) for each n.

    A word that repeats the word before it counts once.
    """
    low = LOWER[data]
    inside = CLASSES["space"][low]
    low[~inside] = 32
    start, end = bounds(inside, offsets)
    word = hashes(low, start, end)
    again = np.flatnonzero(word[1:] == word[:-1]) + 1
    if len(again):
        size = end[again] - start[again]
        low[np.repeat(start[again] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = 32
    at = offsets + np.arange(len(offsets))  # a space before every row and after the last
    padded = np.full(len(low) + len(offsets), 32, np.uint8)
    body = np.ones(len(padded), bool)
    body[at] = False
    padded[body] = low
    gap = padded == 32
    gaps = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(gap, out=gaps[1:])
    value = padded.astype(np.uint32)
    h = value.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[: len(padded) - n + 1] if n <= len(padded) else h[:0]
        h = h * np.uint32(0x01000193) + value[n - 1 :][: len(h)]
        if n in SIZES:
            inner = gaps[n - 1 : n - 1 + len(h)] == gaps[1 : 1 + len(h)]  # no space but at the ends
            place = np.flatnonzero(inner)
            x = h[place] + np.uint32(n)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            yield (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1), np.searchsorted(place, at)


def _bags(batches):
    """(label, text) and any columns after them -> the same with the text's ids and counts for the text."""
    for batch in batches:
        ids, weights = [], []
        for a, b, data, offsets in texts(batch.column(1)):
            found = list(grams(data, offsets))
            for r in range(b - a):
                own, times = np.unique(np.concatenate([g[c[r] : c[r + 1]] for g, c in found]), return_counts=True)
                ids.append(own.astype(np.uint32).tobytes())
                weights.append((times / (BLANK + times.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(weights, pa.binary()), *batch.columns[2:]],
                                         names=["label", "ids", "counts", *batch.schema.names[2:]])


def _adam(value, grad, state, step, rate, floor=1e-8):
    """floor: gradients well below it move little; it keeps n-grams that few rows have near their start."""
    m, v = state
    m += 0.1 * (grad - m)
    v += 0.01 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + floor)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 180, rate: float = 0.08,
        clean_weight: float = 1.0) -> tuple[np.ndarray, float]:
    """Bags of (label, buckets, weights) -> margin per bucket and bias, so that 0 is the best cut.

    A fifth of each class is held out to stop at the best epoch and to place the cut (where that is too few
    rows, all are used); there a row of class 0 stands for clean_weight rows.
    """
    rng = np.random.default_rng(1)
    labels = np.array([y for y, _, _ in bags])
    order = rng.permutation(len(bags))
    fifth = [own[: len(own) // 5] for own in (order[labels[order] == 0], order[labels[order] == 1])]
    test = np.concatenate(fifth)
    train = order[~np.isin(order, test)]
    if min(map(len, fifth)) < 5:
        test = order
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in (("v", vectors), ("s", soft), ("b", bias))}
    best, kept, step = -1.0, None, 0

    def joined(rows):
        size = [len(bags[i][1]) for i in rows]
        return np.concatenate([bags[i][1] for i in rows]), np.concatenate([bags[i][2] for i in rows]), np.repeat(np.arange(len(rows)), size)

    batch = min(512, max(32, len(train) // 12), len(train))
    for _ in range(-(-steps * batch // len(train))):
        shuffled = rng.permutation(train)
        for k in range(0, len(train), batch):
            rows, step = shuffled[k : k + batch], step + 1
            ids, w, owner = joined(rows)
            mean = np.stack([np.bincount(owner, w * vectors[ids, d], len(rows)) for d in range(DIM)], 1)
            logits = mean @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g = p / len(rows)
            back = g @ soft.T  # the same for every n-gram of a row, times its weight
            grad = np.stack([np.bincount(ids, w * back[owner, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            _adam(soft, (mean.T @ g).astype(np.float32), state["s"], step, rate)
            _adam(bias, g.sum(0).astype(np.float32), state["b"], step, rate)
            _adam(vectors, grad, state["v"], step, rate, 1e-4)
        margin = vectors @ (soft[:, 1] - soft[:, 0])
        ids, w, owner = joined(test)
        score = np.bincount(owner, w * margin[ids], len(test)) + bias[1] - bias[0]
        good, cut = _cut(score, labels[test], clean_weight)
        if good >= best:
            best, kept = good, (margin.astype(np.float32), float(bias[1] - bias[0] - cut))
    return kept


def _cut(score: np.ndarray, label: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Best F1 over cuts between scores (the middle of the gap) and that cut."""
    order = np.argsort(-score)
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(1 - label[order]) + max(1, label.sum()))
    k = int(np.argmax(f1))
    low = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 1
    gap = max(float(score[order[k]] - low), 1e-6)
    return float(f1[k]) + 1e-6 * min(1.0, gap), float((score[order[k]] + low) / 2)


def held_out(key, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold


def thinned(rows: DataFrame, key: str, wanted: int, there: int) -> DataFrame:
    """About 2 * wanted of `there` rows (all, if fewer), by hash of the key, so that taking the first
    `wanted` in hash order gathers few rows however many partitions there are."""
    share = min(1.0, 2 * wanted / max(1, there))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


def known_labels(labels: DataFrame, label: str, key: str, folds: int, fold: int) -> DataFrame:
    """(_doc, _label): one row per key outside the held-out fold. A key labelled in several rows takes its
    largest label; null keys and labels other than 0 and 1 are left out."""
    return labels.where(~held_out(key, folds, fold)).where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_doc")).agg(
        F.max(label).cast("int").alias("_label"))


def label_counts(known: DataFrame):
    """Keys of class 0 and 1 as zeros and ones."""
    return known.agg(F.count_if(F.col("_label") == 0).alias("zeros"), F.count_if(F.col("_label") == 1).alias("ones")).first()


def sample(known: DataFrame, most: int, counts) -> DataFrame:
    """At most `most` keys of class 1 and 3 * most of class 0, taken by the key's hash."""
    parts = [
        thinned(known.where(F.col("_label") == k), "_doc", n, there).orderBy(F.pmod(F.xxhash64("_doc"), F.lit(1 << 30)), "_doc").limit(n)
        for k, n, there in ((0, 3 * most, counts.zeros), (1, most, counts.ones))
    ]
    return parts[0].unionByName(parts[1])


def per_key(rows: DataFrame, keys: list[str], digest: str, values: list[str], most: int = TEXTS) -> DataFrame:
    """(keys, values) of at most `most` different texts of each key, by the text's hash.

    An aggregate, so copies and the many texts of one key are reduced in the tasks that read them.
    """
    least = F.min(F.struct(digest, *values)).alias("_least")
    return rows.groupBy(*keys, F.pmod(digest, F.lit(most)).alias("_slot")).agg(least).select(*keys, *(f"_least.{v}" for v in values))


class Model:
    """Margin per bucket; score puts the cut at 0.7."""

    def __init__(self, margin: np.ndarray | None, bias: float, threshold: float = 0.7):
        self.margin, self.bias, self.threshold = margin, bias, threshold

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.margin is None:
            return out
        for a, b, data, offsets in texts(column):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for ids, cuts in grams(data, offsets):
                sums = np.concatenate([[0.0], np.cumsum(self.margin[ids], dtype=np.float64)])
                total += sums[cuts[1:]] - sums[cuts[:-1]]
                count += np.diff(cuts)
            out[a:b] = total / (BLANK + count)
        z = out + self.bias + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 3, fold: int = 1, max_rows: int = 1500, max_texts: int = TEXTS) -> Model:
    """Fit on at most max_rows labelled keys of class 1 and 3 * max_rows of class 0, each with at most max_texts
    different texts, by hash; copies count once. However few rows of the two classes there are, they are fitted. One
    class alone, or no labelled document, gives a model that scores 0, so that nothing is rejected."""
    known = known_labels(labels, label, key, folds, fold)
    counts = label_counts(known)
    wanted = sample(known, max_rows, counts)  # at most 4 * max_rows rows, so broadcast
    seen = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("_text")).join(F.broadcast(wanted), "_doc")
    kind = docs.schema[key].dataType.simpleString()
    bags = seen.select("_label", "_text", "_doc", F.xxhash64("_text").alias("_hash")).mapInArrow(
        _bags, f"label int, ids binary, counts binary, _doc {kind}, _hash long")
    bags = per_key(bags, ["_doc", "label"], "_hash", ["ids", "counts"], max_texts).select("label", "ids", "counts")
    ratio = counts.zeros / max(1, counts.ones)

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows = [(y, np.frombuffer(i, np.uint32), np.frombuffer(n, np.float32)) for y, i, n in sorted(rows)]
        ones = sum(y for y, _, _ in rows)
        if 0 < ones < len(rows):
            margin, bias = fit(rows, clean_weight=max(1.0, ratio * ones / (len(rows) - ones)))
            yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()], pa.binary()), pa.array([bias])], names=["margin", "bias"])

    # The sample is bounded, so one task ends the aggregate and fits it; only the margins come to the driver.
    found = bags.coalesce(1).mapInArrow(run, "margin binary, bias double").collect()
    return Model(np.frombuffer(found[0].margin, np.float32), found[0].bias) if found else Model(None, 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, held_out, score, predicted (score >= 0.7).

    Null texts score as empty ones; a null key is scored and not held out; repeated rows are scored alike.
    Extra columns are ignored.
    """
    model = train(docs, labels, key, text, **options)
    folds, fold = options.get("folds", 3), options.get("fold", 1)

    def run(batches):
        for batch in batches:
            score = model.score(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= model.threshold).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(held_out(key, folds, fold), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that score below 0.7, with all their columns, in the tasks that read them."""
    model, place = train(docs, labels, key, text, **options), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(place)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
