"""Quality by Bradley-Terry: document scores learnt from preference pairs of all labelled documents.

A labelled good document is preferred to a labelled bad one. Logistic loss on the difference of their
features gives the weights; a document's strength is its weighted feature sum. The strength is cut at the
quantile that the training labels give to class 0, and mapped so that the cut has score 0.3.

Features are counts over the bytes and words of the whole text, one pass in numpy, kept as a narrow table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.functions.ranks import rank_select
from pitlake.llm.toxicity import held_out, known_labels, label_counts, sample
from pitlake.llm.words import shingles, texts, words


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


_BYTES = {
    "lower": _table((97, 123)), "upper": _table((65, 91)), "digit": _table((48, 58)), "line": _table((10, 11)),
    "stop": _table((46, 47), (44, 45)), "mark": _table((33, 34), (63, 64)), "sign": _table((35, 44), (94, 95), (126, 127)),
    "bar": _table((124, 125)), "other": _table((45, 46), (47, 48), (58, 63), (64, 65), (91, 94), (95, 97), (123, 124), (125, 126)),
}
NAMES = [*_BYTES, "beyond", "words", "distinct", "distinct_pairs", "top", "again", "length", "spread", "capital", "line_length"]


def features(column: pa.Array) -> np.ndarray:
    """One row of len(NAMES) numbers per text; a text without words gives zeros but for its length."""
    out = np.zeros((len(column), len(NAMES)), np.float32)
    for a, b, data, offsets in texts(column):
        size = np.maximum(1, np.diff(offsets))
        for k, (_, table) in enumerate(_BYTES.items()):
            sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
            out[a:b, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
        k = len(_BYTES)
        out[a:b, k] = 1 - out[a:b, :k].sum(1)
        lines = np.maximum(1, np.round(out[a:b, 3] * size) + 1)
        w = words(data, offsets, "space")
        length = (w.end - w.start).astype(np.float32)
        upper = (data[w.start] >= 65) & (data[w.start] <= 90)
        for r in range(b - a):
            i, j = w.first[r], w.first[r + 1]
            n = int(j - i)
            out[a + r, k + 1] = math.log1p(n)
            if n:
                own = w.hash[i:j]
                times = np.unique(own, return_counts=True)[1]
                pairs = len(np.unique(shingles(own, 2))) / (n - 1) if n > 1 else 1.0
                mean = float(length[i:j].mean())
                out[a + r, k + 2 :] = (len(times) / n, pairs, times.max() / n, float((own[1:] == own[:-1]).sum()) / n, mean,
                                       float(length[i:j].std()), float(upper[i:j].mean()), math.log1p(n / lines[r]))
    return out


def _featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            flat = pa.array(features(batch.column(1)).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(flat, len(NAMES)).cast(pa.list_(pa.float32()))], names=[key, "x"])

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, x array<float>")


class Model:
    """Strength of a feature row and its score, 0.3 at the cut."""

    def __init__(self, mean, scale, weight, cut: float, slope: float, threshold: float = 0.3):
        self.mean, self.scale, self.weight, self.cut, self.slope, self.threshold = mean, scale, weight, cut, slope, threshold

    def _rich(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._rich(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: Labelled rows of one block, about, pairs that a row of a block is in, and rows of each class a block has at least, about.
BLOCK, PAIRS, LEAST = 4096, 8, 32
RIDGE, STEPS, SLOPES = 5.0, 30, 64


def _blocks(rows: DataFrame, zeros: int, ones: int) -> DataFrame:
    """One row (labels, xs) per block of the labelled rows (_label, _hash, x), with rows of both classes.

    Every row is in a block. Rows of a class too rare for the number of blocks are in several, so that all rows of the
    other class are in pairs too; `own` marks the block that counts such a row by itself.
    """
    blocks = -(-(zeros + ones) // BLOCK)
    copies = F.when(F.col("_label") == 1, min(blocks, -(-LEAST * blocks // ones))).otherwise(min(blocks, -(-LEAST * blocks // zeros)))
    dealt = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("_block", F.pmod(F.col("_hash") + F.col("_copy"), F.lit(blocks)))

    def gathered(table: pa.Table) -> pa.Table:
        x = np.array(table.column("x").to_pylist(), np.float32)
        y, own = table.column("_label").to_numpy(), table.column("_copy").to_numpy() == 0
        order = np.lexsort((*x.T, ~own, y))
        return pa.table({"labels": [y[order].astype(np.int8).tobytes()], "own": [own[order].tobytes()], "xs": [x[order].tobytes()]})

    return dealt.select("_block", "_label", "_copy", "x").groupBy("_block").applyInArrow(gathered, "labels binary, own binary, xs binary")


def _sums(blocks: DataFrame, of) -> np.ndarray:
    """Sum over all blocks of of(x, label, own), an array of numbers; one short row per task comes to the driver."""
    def run(batches):
        total = None
        for batch in batches:
            for labels, own, xs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(labels, np.int8)
                part = of(np.frombuffer(xs, np.float32).reshape(len(y), -1).astype(np.float64), y, np.frombuffer(own, bool))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = sorted(r.sums for r in blocks.select("labels", "own", "xs").mapInArrow(run, "sums binary").collect())
    return np.sum([np.frombuffer(x) for x in found], axis=0)


def _pairs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad rows of a block that meet, each row in several pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    take = max(2000, PAIRS * len(y)) if len(good) and len(bad) else 0
    rng = np.random.default_rng(3)
    return np.resize(rng.permutation(good), take), np.resize(rng.permutation(bad), take)[rng.permutation(take)]


def fit(rows: DataFrame) -> Model | None:
    """Model of all rows (_label, _hash, x); None where they are of one class only.

    Newton steps over preference pairs, whose sums are added up over blocks of rows; no row is left out. The cut is the
    exact order statistic of all strengths.
    """
    sizes = {r._label: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    n = sum(sizes.values())
    blocks = land(_blocks(rows, sizes[0], sizes[1]), "quality-blocks")
    width = len(NAMES)
    first = _sums(blocks, lambda x, y, own: x[own].sum(0))  # each row once
    mean = first / n
    spread = _sums(blocks, lambda x, y, own: ((x[own] - mean) ** 2).sum(0)) / n
    model = Model(mean, np.maximum(np.sqrt(spread), 1e-6), np.zeros(2 * width), 0.0, 1.0)

    def pair_sums(x, y, own):
        i, j = _pairs(y)
        rich = model._rich(x)
        d = rich[i] - rich[j]
        p = 1 / (1 + np.exp(-np.clip(d @ model.weight, -30, 30)))
        return np.concatenate([d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

    for _ in range(STEPS):
        found = _sums(blocks, pair_sums)
        grad, curve = found[: 2 * width], found[2 * width :].reshape(2 * width, -1)
        step = np.linalg.solve(curve + RIDGE * np.eye(2 * width), grad + RIDGE * model.weight)
        model.weight = model.weight - step
        if np.abs(step).max() < 1e-6:
            break

    def strengths(batches):
        for batch in batches:
            for own, xs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(own, bool)
                x = np.frombuffer(xs, np.float32).reshape(len(mine), -1).astype(np.float64)[mine]
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(x))], names=["s"])

    at = min(sizes[0] - 1, n - 2)
    both = {"low": lambda _: F.lit(at), "high": lambda _: F.lit(at + 1)}
    cut = rank_select(land(blocks.select("own", "xs").mapInArrow(strengths, "s double"), "strengths"), "s", both, few_groups=True).first()
    model.cut = (cut.low + cut.high) / 2
    # The slope's gradient rises with the slope: read it at many slopes in one pass, then between two of them.
    low, high = 0.05, 1e4
    for _ in range(3):
        tried = np.geomspace(low, high, SLOPES)

        def slope_sums(x, y, own, tried=tried):
            s = model.strength(x[own]) - model.cut
            return np.array([(s * (1 / (1 + np.exp(-np.clip(k * s, -30, 30))) - y[own])).sum() for k in tried])

        k = int(np.searchsorted((_sums(blocks, slope_sums) + 1e-3 * tried) > 0, True))
        low, high = tried[max(0, k - 1)], tried[min(k, SLOPES - 1)]
    model.slope = float(low)
    return model


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
            folds: int = 5, fold: int = 0, max_rows: int | None = None) -> DataFrame:
    """One row per document: key, held_out, score, predicted (score >= 0.3).

    Fits on every labelled key outside the held-out fold with each of its different texts, copies once;
    max_rows, for trials, asks for no more than that many keys of class 1 and 3 * max_rows of class 0, by hash. Null texts count as empty ones and are scored; a null key is scored and not held out; repeated rows
    are scored alike. Labels of one class only, or none, score everything 1. Extra columns are ignored.
    """
    known = known_labels(labels, label, key, folds, fold)
    if max_rows is not None:
        known = sample(known, max_rows, label_counts(known))
    # Texts are read once and never exchanged: features are landed, learnt from where labelled, and scored.
    both = F.struct(F.col(key).alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_own"))
    made = land(_featured(docs.select(both.alias("_doc"), F.col(text).alias("_text")), "_doc", "_text"), "quality-features")
    seen = made.select(F.col("_doc._key").alias("_doc"), "_doc._own", "x").join(known, "_doc")
    rows = seen.groupBy("_doc", "_label", "_own").agg(F.min("x").alias("x"))  # copies of one key have equal texts and so equal features
    model = fit(land(rows.select("_label", F.xxhash64("_doc", "_own").alias("_hash"), "x"), "quality-rows"))

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(NAMES))
            score = model.score(x) if model else np.ones(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.3).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return made.select("_doc._key", F.coalesce(held_out("_doc._key", folds, fold), F.lit(False)).alias("held_out"), "x").mapInArrow(
        run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
