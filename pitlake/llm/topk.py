"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are integers. With segments of equal length, q.x is at most the sum over segments of
len * (mean_q mean_x + dev_q dev_x), by Cauchy-Schwarz on what is left of each segment after its mean: the
same as a lower bound |q|^2 + |x|^2 - 2 q.x of the squared distance. Coarse segments first, then finer
ones, down to half as many segments as components, and only survivors of the finest bound get an exact
product. An orthogonal change of basis leaves inner products as they are, so a task first turns its vectors
to the principal axes of its candidates, largest variance first: the first segments then hold most of
what tells candidates apart. Bounds are floats with slack above their rounding; products are exact integers.

Candidates are dealt into blocks and queries into groups; each pair of a block and a group is one task
that keeps k rows per query, and a window over those takes the k best. A query's first threshold in a task is
the k-th best exact score among the candidates with the highest leading components of the product; at the
finest level it rises to the k-th best among the candidates of the highest bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land

LEVELS = (1, 4, 16, 0.5)  # segments; below 1 a share of the components
LEAD = 8  # leading axes that choose the candidates of the first threshold


def _axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal principal axes of the rows as columns, largest variance first."""
    y = x.astype(np.float64)
    y -= y.mean(0)
    return np.linalg.eigh(y.T @ y)[1][:, ::-1]


def _stats(x: np.ndarray, parts: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each segment, and segment lengths."""
    parts = parts if parts >= 1 else max(1, int(parts * x.shape[1]))
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    sums = np.add.reduceat(x.astype(np.float64), edges[:-1], axis=1)
    squares = np.add.reduceat(x.astype(np.float64) ** 2, edges[:-1], axis=1)
    mean = sums / size
    return mean, np.sqrt(np.maximum(0, squares / size - mean**2)), size


def _bound(query, base) -> np.ndarray:
    """Upper bound of q.x for rows of both, a little above rounding."""
    (qm, qd, size), (xm, xd, _) = query, base
    top = (qm * size) @ xm.T + (qd * size) @ xd.T
    return top + 1e-6 * (np.abs(top) + 1) + 1e-9 * (np.abs(qm * size) @ np.abs(xm).T)


def _kth(own, base, i, j, bound, k: int) -> np.ndarray:
    """Per query the k-th best exact score among the 4 k pairs of the highest bounds, or -inf where there are fewer than k."""
    order = np.lexsort((-bound, i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, place = i[place < 4 * k], j[place < 4 * k], place[place < 4 * k]
    score = np.full((len(own), 4 * k), -np.inf)
    score[i, place] = np.einsum("nd,nd->n", own[i], base[j])
    return np.sort(score, axis=1)[:, -k]


def search_block(queries: np.ndarray, base: np.ndarray, query_ids: np.ndarray, base_ids: np.ndarray, k: int, kept: list | None = None):
    """Exact k best of a block for each query -> (query index, base index, score), ties to the smaller base id.

    kept, when given, gets the pairs alive before the first and after each level added up.
    """
    axes = _axes(base)
    turned = queries @ axes, base @ axes
    far = 1e-12 * queries.shape[1]  # rounding of a turned product, in terms of both norms
    norms = tuple(np.linalg.norm(x, axis=1) for x in turned)
    stats = [(_stats(turned[0], n), _stats(turned[1], n)) for n in LEVELS]
    kept = [] if kept is None else kept
    kept += [0] * (len(LEVELS) + 1 - len(kept))
    seed = min(len(base), 4 * k + 1)
    out = []
    step = max(1, (1 << 22) // max(1, len(base), seed * base.shape[1]))
    for at in range(0, len(queries), step):
        part = slice(at, min(at + step, len(queries)))
        own = queries[part]
        guess = turned[0][part, :LEAD] @ turned[1][:, :LEAD].T
        same = query_ids[part][:, None] == base_ids[None, :]
        guess[same] = -np.inf
        near = np.argpartition(guess, len(base) - seed, axis=1)[:, -seed:]
        first = np.einsum("qd,qsd->qs", own.astype(np.float64), base[near].astype(np.float64))
        first[np.take_along_axis(same, near, 1)] = -np.inf
        need = np.sort(first, axis=1)[:, -k] if seed >= k else np.full(len(own), -np.inf)
        cut = [tuple(x[part] if i < 2 else x for i, x in enumerate(q)) for q, _ in stats]
        room = far * norms[0][part]
        alive = _bound(cut[0], stats[0][1]) + room[:, None] * norms[1] >= need[:, None]
        i, j = np.nonzero(alive & ~same)
        kept[0] += int((~same).sum())
        kept[1] += len(i)
        for level, ((qm, qd, size), (_, (xm, xd, _))) in enumerate(zip(cut[1:], stats[1:], strict=True), 2):
            bound = np.zeros(len(i))
            for a in range(0, len(i), 1 << 18):
                p, q = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
                top = ((qm[p] * xm[q] + qd[p] * xd[q]) * size).sum(1)
                slack = 1e-6 * (np.abs(top) + 1) + 1e-9 * (np.abs(qm[p] * xm[q]) * size).sum(1)
                bound[a : a + (1 << 18)] = top + slack + room[p] * norms[1][q]
            if level == len(LEVELS):
                need = np.maximum(need, _kth(own, base, i, j, bound, k))
            keep = bound >= need[i]
            i, j = i[keep], j[keep]
            kept[level] += len(i)
        score = np.zeros(len(i), np.int64)
        for a in range(0, len(i), 1 << 18):
            score[a : a + (1 << 18)] = np.einsum("nd,nd->n", own[i[a : a + (1 << 18)]], base[j[a : a + (1 << 18)]])
        order = np.lexsort((base_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        head = np.searchsorted(i, np.arange(len(own)))
        best = np.arange(len(i)) - head[i] < k
        out.append((i[best] + at, j[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() for b in column), np.int64).reshape(-1, dim)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
          every: int = 100, block: int = 8192, group: int = 1024) -> DataFrame:
    """(query_id, rank, key, score): the k best integer inner products of every query row.

    Components become floor(scale * x). Queries are the rows whose key is divisible by `every`; candidates
    are all rows with another key. Ties go to the smaller key. Vectors that are null or hold null or
    non-finite components, and rows with a null key, take no part; nor do vectors shorter or longer than a
    query's (each length is searched by itself). A repeated key is one candidate per row. An empty table
    gives no rows. Extra columns are ignored. Scores are 64-bit: a table whose products may pass 2^62 fails
    with an error instead of wrapping around.
    """
    wide = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = "v is not null and id is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and size(v) > 0"

    def packed(batches):
        for batch in batches:
            v = batch.column(1)
            raw = [np.floor(scale * np.asarray(x, np.float64)) for x in v.to_pylist()]
            if any(x @ x >= 2.0**62 for x in raw):
                raise ValueError("components too large for 64-bit inner products")
            raw = [x.astype(np.int64).tobytes() for x in raw]
            dims = pa.array([len(x) // 8 for x in raw], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), dims, pa.array(raw, pa.binary())], names=["id", "dim", "x"])

    rows = land(wide.where(fine).mapInArrow(packed, "id long, dim int, x binary"), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    blocks, groups = max(1, -(-size.n // block)), max(1, -(-size.q // group))
    base = rows.withColumn("b", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.where(F.col("id") % every == 0).withColumn("g", F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(groups)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            dim = left["dim"][0].as_py()
            qi, xi = left["id"].to_numpy(), right["id"].to_numpy()
            i, j, s = search_block(_matrix(left["x"], dim), _matrix(right["x"], dim), qi, xi, k)
            q, x = qi[i], xi[j]
        return pa.Table.from_arrays([pa.array(q), pa.array(x), pa.array(s)], names=["query_id", key, "score"])

    found = asked.groupBy("dim", "b", "g").cogroup(base.groupBy("dim", "b", "g")).applyInArrow(run, f"query_id long, `{key}` long, score long")
    place = F.expr(f"row_number() over (partition by query_id order by score desc, `{key}`)")
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
