"""Hard negatives by a vertical scan with branch and bound over dimensions.

A block of candidates is held by columns. An anchor reads the columns in descending magnitude of its own
components; what the unread columns can still add to a candidate's product lies between the sums of the
smaller and of the larger of q_d * min_d and q_d * max_d, with the block's least and largest value of each
column. So every candidate has an interval around its final product, and a bitmap keeps those whose
interval can still matter. Nothing is cut by a guess: survivors have read every column, so their products
are exact integers.

Two scans of all rows answer a group of anchors. The first keeps the k best rows of the anchor's label.
Their scores open one window per positive, and the second keeps the k best rows of other labels in each
window. Every task carries its own best rows through its partition as thresholds and sends k rows per
anchor (or window); a ranking over those few gives the answer. Candidates are never shuffled or copied. Groups of
anchors have a fixed size, which bounds what a task is sent; each group's answer is landed before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land

#: Columns read between two looks at the bitmap.
STRIDE = 8
LEAST = np.iinfo(np.int64).min


class Block:
    """One or more candidates of one length by columns: ids, labels, x[column, row]; sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.largest = int(np.abs(x).max())
        order = np.argsort(labels, kind="stable")
        self.edges = dict(zip(*(a.tolist() for a in np.unique(labels[order], return_index=True)), strict=True))
        self.ids, self.labels, self.x = ids[order], labels[order], np.ascontiguousarray(x[:, order])
        self.low, self.high = self.x.min(axis=1), self.x.max(axis=1)

    def of(self, label: int) -> slice:
        """The rows of one label; they lie together."""
        at = self.edges.get(label)
        if at is None:
            return slice(0, 0)
        return slice(at, at + int(np.searchsorted(self.labels[at:], label, side="right")))


def checked(q: np.ndarray, block: Block) -> None:
    """An integer product that could leave 64 bits fails the job."""
    if len(q) * int(np.abs(q).max(initial=0)) * block.largest >= 2**63:
        raise OverflowError("an inner product of scaled vectors does not fit in 64 bits")


def vertical(q: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(rows, products, survivors per look) of the columns x that `alive` lets through.

    alive(at_least, at_most, rows) is the bitmap over rows whose products lie in [at_least, at_most].
    """
    order = np.argsort(-np.abs(q), kind="stable")
    a, b = q[order] * low[order], q[order] * high[order]
    least = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    most = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    rows, part, seen, at = np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64), [], 0
    while True:
        keep = alive(part + least[at], part + most[at], rows)
        rows, part = rows[keep], part[keep]
        seen.append(len(rows))
        if at == len(q) or not len(rows):
            return rows, part, seen
        for d in order[at : at + STRIDE]:
            part = part + q[d] * x[d, rows]
        at = min(at + STRIDE, len(q))


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest, or less than any score if there are fewer."""
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else LEAST


class Best:
    """The k best (score, id) pairs met so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            top = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[top], ids[top]

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.k else LEAST


def positives_in(block: Block, q: np.ndarray, anchor: int, label: int, best: Best) -> list[int]:
    """Add the block's rows of the anchor's label to its best; survivors per look."""
    part = block.of(label)
    x, ids = block.x[:, part], block.ids[part]
    if not len(ids):
        return []
    checked(q, block)
    other = ids != anchor

    def alive(at_least, at_most, rows):
        own = other[rows]
        return own & (at_most >= max(best.floor, kth(at_least[own], best.k)))

    rows, score, seen = vertical(q, x, x.min(axis=1), x.max(axis=1), alive)
    best.add(score, ids[rows])
    return seen


def negatives_in(block: Block, q: np.ndarray, label: int, windows: list[tuple[int, int]], best: list[Best]) -> list[int]:
    """Add the block's rows of other labels to the best of every window [low, high] of scores; survivors per look."""
    if not windows:
        return []
    checked(q, block)
    other = np.ones(len(block.ids), bool)
    other[block.of(label)] = False

    def alive(at_least, at_most, rows):
        own, keep = other[rows], np.zeros(len(rows), bool)
        for (low, high), b in zip(windows, best, strict=True):
            inside = at_least[own & (at_least >= low) & (at_most <= high)]
            keep |= (at_most >= max(low, b.floor, kth(inside, b.k))) & (at_least <= high)
        return keep & own

    rows, score, seen = vertical(q, block.x, block.low, block.high, alive)
    for (low, high), b in zip(windows, best, strict=True):
        hit = (score >= low) & (score <= high)
        b.add(score[hit], block.ids[rows[hit]])
    return seen


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of candidates of one length out of (id, label, x) batches."""
    for batch in batches:
        lists = batch.column(2)
        size, flat = np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(zero_copy_only=False)
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            yield Block(ids[rows], labels[rows], flat[at[rows][:, None] + np.arange(dim)].T)


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int, flip: int, labels: int) -> DataFrame:
    """(id, label, x): rows that take part, with floor(scale * component) and labels of every flip-th key moved on."""
    wide = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    whole = ("id is not null and label is not null and size(v) > 0"
             " and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    fits = F.expr(f"forall(v, c -> abs({scale} * c) < 9e18)")
    x = F.when(fits, F.expr(f"transform(v, c -> cast(floor({scale} * c) as bigint))")).otherwise(
        F.raise_error(F.lit("a scaled component does not fit in 64 bits")))
    moved = F.when(F.col("id") % flip == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")) if flip else F.col("label")
    return wide.where(whole).select("id", moved.alias("label"), x.alias("x"))


def _collected(rows: DataFrame) -> dict[int, list]:
    """Anchors of one group by length of vector: (id, label, vector)."""
    found: dict[int, list] = {}
    for r in rows.collect():
        found.setdefault(len(r.x), []).append((r.id, r.label, np.array(r.x, np.int64)))
    return found


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, scale: int = 256,
                   every: int = 100, flip: int = 7, labels: int = 10, n_positives: int = 5, n_negatives: int = 10,
                   low: int = 30, high: int = 90, group: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); the label of a key divisible by `flip` becomes (label + 1) mod
    `labels` (flip=0: none). Anchors are the rows whose key is divisible by `every`, their positives the
    `n_positives` best other rows of the same label. Per anchor and positive come the `n_negatives` best rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Higher
    scores come first, ties by smaller key. A negative positive_score has no window.

    Rows with a null key, label or vector, an empty vector or a null or non-finite component take no part. A
    repeated key is one candidate per row; as an anchor it counts once, with its least label and vector, and
    rows with the anchor's key are never among its own positives. Only vectors of the anchor's length are
    compared. A product that could leave 64 bits fails the job. An empty table gives no rows; extra columns
    are ignored. `group` anchors are searched at a time: what one task is sent is `group` vectors and
    windows, whatever the size of the table.
    """
    spark = vectors.sparkSession
    rows = land(integers(vectors, key, vector, label, scale, flip, labels), "vectors")
    asked = land(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x"), "anchors")
    groups = max(1, -(-asked.count() // group))
    paths = []
    for g in range(groups):
        anchors = _collected(asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g))
        paths.append(_group(rows, anchors, n_positives, n_negatives, low, high, g).inputFiles())
    kept = [p for some in paths for p in some]
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(shape).parquet(*kept) if kept else spark.createDataFrame([], shape)


def _group(rows: DataFrame, anchors: dict[int, list], n_positives: int, n_negatives: int, low: int, high: int, number: int) -> DataFrame:
    def same_label(batches):
        best: dict[tuple[int, int], Best] = {}
        for block in blocks(batches):
            for anchor, label, q in anchors.get(block.x.shape[0], ()):
                positives_in(block, q, anchor, label, best.setdefault((anchor, len(q)), Best(n_positives)))
        for (anchor, _), b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), anchor)), pa.array(b.id), pa.array(b.score)], names=["anchor_id", "id", "score"])

    found = rows.mapInArrow(same_label, "anchor_id long, id long, score long")
    place = F.expr("row_number() over (partition by anchor_id order by score desc, id)")
    positives = land(found.withColumn("place", place).where(F.col("place") <= n_positives), f"positives-{number}")
    windows: dict[int, list[tuple[int, int, int]]] = {}
    for r in positives.orderBy("anchor_id", "place").collect():  # at most n_positives rows per anchor of the group
        if r.score >= 0:
            windows.setdefault(r.anchor_id, []).append((r.id, r.place, r.score))

    def in_windows(batches):
        best: dict[int, list[Best]] = {}
        for block in blocks(batches):
            for anchor, label, q in anchors.get(block.x.shape[0], ()):
                if anchor in windows:
                    spans = [(-(-low * s // 100), high * s // 100) for _, _, s in windows[anchor]]
                    negatives_in(block, q, label, spans, best.setdefault(anchor, [Best(n_negatives) for _ in spans]))
        for anchor, found in best.items():
            for (positive, place, score), b in zip(windows[anchor], found, strict=True):
                n = len(b.id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, positive)), pa.array(np.full(n, place, np.int32)), pa.array(b.id),
                     pa.array(np.full(n, score)), pa.array(b.score)],
                    names=["anchor_id", "positive_id", "place", "negative_id", "positive_score", "negative_score"])

    found = rows.mapInArrow(in_windows, "anchor_id long, positive_id long, place int, negative_id long, positive_score long, negative_score long")
    rank = F.expr("row_number() over (partition by anchor_id, place order by negative_score desc, negative_id)").cast("int")
    return land(found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"negatives-{number}")
