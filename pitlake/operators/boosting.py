"""Boosted trees: staged cross-validation over a grid, and an exact audit of monotone signs.

Trees are MLlib's, grown for many models at once: MLlib takes some three Spark jobs a round and model, here they are three
a round for all. A fit with the most rounds of its shape answers every smaller number of rounds too, since
round k does not know how many follow; so the grid costs one fit per (depth, leaf size, fold). The trees and scores of
each are landed, and fits that are there are not repeated.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions.landing import land, shared_folder
from pitlake.operators.learn import check_inputs, finite

# Grid, step and declared signs.
DEPTHS, LEAVES, ROUNDS = (2, 3), (10, 20), (150, 300)
STEP = 0.05
SIGNS = {
    "goals": 1,
    "assists": 1,
    "minutes": 1,
    "appearances": 0,
    "goals_per90": 1,
    "assists_per90": 1,
    "age": -1,
}

#: Bins an input gets, rows its thresholds are taken from, bin of a node without a split (MLlib's values, but the last).
BINS, SAMPLED, NO_SPLIT = 32, 10_000, 255
#: Bits of a bin, and bins packed into a long.
BITS = (BINS - 1).bit_length()
PACKED = 63 // BITS
#: Cells of a cached block, rounds between kept predictions, and kept predictions between cuts of their lineage.
BLOCK_ROWS, KEPT_EVERY, CUT_EVERY = 50_000, 4, 10

NODES = "tree int, weight double, node int, feature int, threshold double, value double"
SCORES = "grid_order int, candidate string, fold int, rows bigint, log_mae double, eligible boolean"


@dataclass(frozen=True)
class Shape:
    """Trees of one grid point. `order` is its place in the grid, the last tie-breaker."""

    order: int
    depth: int
    leaf: int
    rounds: int

    @property
    def name(self) -> str:
        return f"gbm(max_depth={self.depth}, min_leaf={self.leaf}, rounds={self.rounds})"


def grid(depths: Sequence[int] = DEPTHS, leaves: Sequence[int] = LEAVES, rounds: Sequence[int] = ROUNDS) -> list[Shape]:
    return [Shape(i, *p) for i, p in enumerate(itertools.product(depths, leaves, rounds))]


def assembled(df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Inputs as one vector `x`, the label as `y`. Null or non-finite values fail the job."""
    from pyspark.ml.feature import VectorAssembler

    check_inputs(columns)
    rows = df.select(*keep, finite(label).alias("y"), *(finite(c).alias(c) for c in columns))
    return VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows).select(*keep, "x", "y")


def _bin_edges(values: np.ndarray) -> np.ndarray:
    """Thresholds of one input, by MLlib's rule: all midpoints if they are few, else boundaries nearest to equal counts."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    wanted = min(BINS, len(values)) - 1
    if len(middle) <= wanted:
        return middle
    upto, stride, out = np.cumsum(counts), len(values) / (wanted + 1), []
    for i in range(1, len(found)):
        target = stride * (len(out) + 1)
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
    return np.array(out)


def bin_edges(rows: DataFrame, seed: int) -> list[np.ndarray]:
    """Thresholds per input. Like MLlib's, those of more than SAMPLED rows come from about so many of them; every row is
    learned from."""
    from pyspark.ml.functions import vector_to_array

    n = rows.count()
    if not n:
        raise ValueError("no rows to fit trees on")
    taken = rows if n <= SAMPLED else rows.sample(SAMPLED / n, seed)
    return [_bin_edges(c) for c in np.array([r[0] for r in taken.select(vector_to_array("x")).collect()]).T]


def _tree(depth: int) -> tuple:
    """Input and bin per node of a complete tree, and its leaves. A node whose bin is NO_SPLIT sends every row left."""
    return np.zeros(2**depth - 1, int), np.full(2**depth - 1, NO_SPLIT, np.uint8), np.zeros(2**depth)


def _places(bins: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
    """Place of every row among the nodes below that many levels."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level in range(levels):
        right = np.zeros(len(at), bool)
        for j in range(2**level):
            k = 2**level - 1 + j
            if tree[1][k] != NO_SPLIT:
                right |= (at == j) & (bins[tree[0][k]] > tree[1][k])
        at = at * np.uint8(2) + right
    return at


def _moved(block: tuple, grown: list) -> list:
    """Predictions of a block after further rounds, each a step and a tree per model (None where it has all its own)."""
    (models, _, _, bins), own = block
    out = [f.copy() for f in own] if grown else own
    for step, trees in grown:
        for f, (i, _) in zip(out, models, strict=True):
            if trees[i] is not None:
                f += step * trees[i][2][_places(bins, trees[i], len(trees[i][2]).bit_length() - 1)]
    return out


def _sums(block: tuple, grown: list, trees: list, level: int) -> dict:
    """Rows and summed targets per (node, input, bin) of the trees' nodes at one level, a pair per model."""
    models, rows, labels, bins = block[0]
    found, wide = {}, [b.astype(np.intp) for b in bins]
    for f, (i, depth) in zip(_moved(block, grown), models, strict=True):
        if trees[i] is None or level >= depth:
            continue
        size = 2**level * BINS
        target = labels if trees.first else 2 * (labels - rows * f)
        base = _places(bins, trees[i], level).astype(np.intp) * BINS if level else None
        cells = [b if base is None else base + b for b in wide]
        # The rows of a root's bins are the same in every round.
        counts = [np.bincount(c, rows, size) if level or trees.first else np.zeros(size) for c in cells]
        found[i] = np.array([[n, np.bincount(c, target, size)] for n, c in zip(counts, cells, strict=True)]).reshape(len(bins), 2, -1, BINS)
    return found


class _Growing(list):
    """Trees of one round, a tree or None per model; the first round's targets are the labels."""

    first = False


def _split(tree: tuple, sums: np.ndarray, level: int, leaf: int, edges: list[np.ndarray]) -> None:
    """Split the nodes of a level where that lowers the squared error most; leaves below get their means."""
    depth = len(tree[2]).bit_length() - 1
    n, s = np.cumsum(sums[:, 0], axis=-1), np.cumsum(sums[:, 1], axis=-1)  # input, node, bin
    usable = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]
    for j in range(2**level):
        left, total, sl, st = n[:, j], n[0, j, -1], s[:, j], s[0, j, -1]
        if not total:
            continue
        right, sr = total - left, st - sl
        fits = usable & (left >= leaf) & (right >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, sl * sl / left + sr * sr / right - st * st / total, -1.0)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        span = 2 ** (depth - level)
        tree[2][j * span] = st / total
        if gain[f, b] > 0:
            k = 2**level - 1 + j
            tree[0][k], tree[1][k] = f, b
            tree[2][j * span] = sl[f, b] / left[f, b]
            tree[2][j * span + span // 2] = sr[f, b] / right[f, b]


def _cells(rows: DataFrame, folds: list[tuple], edges: list[list[np.ndarray]]) -> DataFrame:
    """(fold, keys, rows, label): the rows of each fold that share all bins, with how many they are and the sum of their labels.

    A tree sees a row by its bins alone, so rows of one cell always have one prediction, and the sums per bin of a cell
    are those of its rows. Bins are packed into longs, the keys; copies of a cell are summed up before the shuffle.
    """
    from pyspark.ml.functions import vector_to_array

    by, many = next((c for c, _ in folds if c), None), len(edges[0])
    table = rows.select(vector_to_array("x").alias("x"), F.col("y"), (F.col(by) if by else F.lit(0)).cast("double").alias("c"))
    names = [f"_k{i}" for i in range(-(-many // PACKED))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, c = (batch.column(i) for i in range(3))
            x, y, c = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y.to_numpy(), c.to_numpy()
            for fold, (_, limit) in enumerate(folds):
                mine = np.ones(len(y), bool) if limit is None else c < float(limit)
                keys = np.zeros((len(names), int(mine.sum())), np.int64)
                for j, e in enumerate(edges[fold]):
                    keys[j // PACKED] |= np.searchsorted(e, x[mine, j]) << BITS * (j % PACKED)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(keys.shape[1], fold, np.int32)), *map(pa.array, keys), pa.array(y[mine])], names=["fold", *names, "y"])

    every = table.mapInArrow(binned, f"fold int, {', '.join(f'{n} bigint' for n in names)}, y double")
    return every.groupBy("fold", *names).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("y").alias("label"))


def _blocks(cells: DataFrame, models: list[tuple[int, int]], many: int):
    """Cached blocks ((models of the fold, rows and labels per cell, bins), predictions per model), each of cells of one fold."""
    names = [c for c in cells.columns if c.startswith("_k")]

    def block(fold: int, t: pa.Table) -> bytes:
        mine = [(i, depth) for i, (own, depth) in enumerate(models) if own == fold]
        bins = [(t[names[j // PACKED]].to_numpy() >> BITS * (j % PACKED) & (BINS - 1)).astype(np.uint8) for j in range(many)]
        return pickle.dumps(((mine, t["rows"].to_numpy(), t["label"].to_numpy(), np.array(bins)), [np.zeros(len(t)) for _ in mine]), 5)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS):
                t = pa.Table.from_batches(held)
                own = t["fold"].to_numpy()
                found = [block(int(fold), t.filter(pa.array(own == fold))) for fold in np.unique(own)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["block"])
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    context = cells.sparkSession.sparkContext
    tasks = max(1, min(context.defaultParallelism, -(-cells.count() // BLOCK_ROWS)))
    # In order, so that sums over a block do not depend on how its cells came to it.
    return cells.repartition(tasks, *names).sortWithinPartitions("fold", *names).mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r.block))


def fit(rows: DataFrame, depth, leaf, rounds, seed: int = 42, before: Sequence[tuple] | None = None):
    """Boosted trees on assembled rows: MLlib's learner (squared error, 32 bins, first tree whole, then steps), many models at once.

    `depth`, `leaf` and `rounds` are numbers, or one number per model; a list of models then comes back, the i-th
    fitted on the rows whose `before[i][0]` (the same column for all) is below `before[i][1]`. Rows that share all bins are
    one cell from the start, which loses nothing. A round costs one job per level for all models together: tasks send sums per
    node, input and bin, whose size does not depend on the rows. Predictions are kept every few rounds as cached blocks, whose
    lineage is cut in the shared folder.
    """
    from pyspark import StorageLevel

    many = not isinstance(depth, int)
    shapes = list(zip(depth, leaf, rounds, strict=True)) if many else [(depth, leaf, rounds)]
    before = list(before or [(None, None)] * len(shapes))
    folds = list(dict.fromkeys(before))
    edges = [bin_edges(rows if c is None else rows.where(F.col(c) < limit), seed) for c, limit in folds]
    models = [(folds.index(b), d) for b, (d, _, _) in zip(before, shapes, strict=True)]
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    roots: dict[int, np.ndarray] = {}
    cells = land(_cells(rows, folds, edges), "boosting-cells")
    state, stale, grown, done = _blocks(cells, models, len(edges[0])).persist(StorageLevel.MEMORY_AND_DISK), None, [], []

    def merged(found: Iterator[dict]) -> dict:
        total: dict = {}
        for part in found:
            for i, s in part.items():
                total[i] = total[i] + s if i in total else s
        return total

    for m in range(max(r for _, _, r in shapes)):
        if len(grown) == KEPT_EVERY:
            moves, stale = grown, state
            state = state.map(lambda b, moves=moves: (b[0], _moved(b, moves))).persist(StorageLevel.MEMORY_AND_DISK)
            if m % (CUT_EVERY * KEPT_EVERY) == 0:
                state.checkpoint()
            grown = []
        trees = _Growing(_tree(d) if m < r else None for d, _, r in shapes)
        trees.first = m == 0
        for level in range(max(d for (d, _, r) in shapes if m < r)):
            def job(blocks, grown=grown, trees=trees, level=level):
                yield merged(_sums(b, grown, trees, level) for b in blocks)

            parts = state.mapPartitions(job)
            sums = merged(parts.collect()) if parts.getNumPartitions() <= 32 else parts.treeReduce(lambda a, b: merged([a, b]))
            for i, s in sums.items():
                if level == 0:
                    s[:, 0] = roots.setdefault(i, s[:, 0].copy())
                _split(trees[i], s, level, shapes[i][1], edges[models[i][0]])
            if stale is not None:
                stale.unpersist()
                stale = None
        grown = [*grown, (STEP if m else 1.0, list(trees))]
        done.append(trees)
    state.unpersist()
    fitted = [_ensemble([t[i] for t in done if t[i] is not None], edges[fold]) for i, (fold, _) in enumerate(models)]
    return fitted if many else fitted[0]


def staged_errors(models: Sequence[Ensemble], rows: DataFrame, fold: Sequence[int], stages: Sequence[Sequence[int]]) -> list[list[float]]:
    """Mean absolute error of each model after each of its numbers of rounds, in one pass over rows with a column `_fold`."""
    from pyspark.ml.functions import vector_to_array

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, y, own = (part.column(i) for i in range(3))
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                y, own = y.to_numpy(), own.to_numpy()
                for i, model in enumerate(models):
                    mine, start, sofar = own == fold[i], 0, 0.0
                    inputs = x[mine]
                    for k in sorted(set(stages[i])):
                        sofar = sofar + Ensemble(model.trees[start:k], model.weights[start:k], {}).predict(inputs)
                        cell, start = total.setdefault((i, k), [0.0, 0]), k
                        cell[0] += float(np.abs(y[mine] - sofar).sum())
                        cell[1] += int(mine.sum())
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                   pa.array([total[k][0] for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "k", "e", "n"])

    found = rows.select(vector_to_array("x").alias("x"), "y", "_fold").mapInArrow(errors, "i int, k int, e double, n bigint")
    mean = {(r.i, r.k): r.e for r in found.groupBy("i", "k").agg((F.sum("e") / F.sum("n")).alias("e")).collect()}
    return [[mean.get((i, k), float("nan")) for k in own] for i, own in enumerate(stages)]


def _landed_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Scores that an earlier run left there."""
    try:
        found = spark.read.schema(SCORES).parquet(path)
        return None if found.isEmpty() else found
    except AnalysisException:
        return None


def cross_validate(
    train: DataFrame, columns: Sequence[str], label: str, cycle: str, n_folds: int, shapes: Sequence[Shape] | None = None,
    folder: str | None = None, seed: int = 42,
) -> DataFrame:
    """(grid_order, candidate, fold, rows, log_mae, eligible) for every shape and expanding fold.

    Fold k is the k-th of the last n_folds cycles and trains on all cycles before it. Each fit's trees and
    scores are landed under `folder` (a new one if none is given); fits whose scores are there are not repeated.
    """
    spark = train.sparkSession
    shapes = list(shapes or grid())
    rows = land(assembled(train, columns, label, [cycle]), "boosting-rows")
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(cycle).count().collect())  # one row per cycle
    if len(sizes) < n_folds + 1:
        raise ValueError(f"{len(sizes)} training cycles; need {n_folds + 1} for {n_folds} folds")
    folder = folder or f"{shared_folder(spark)}/boosting-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    by_fit: dict[tuple[int, int], list[Shape]] = {}
    for s in shapes:
        by_fit.setdefault((s.depth, s.leaf), []).append(s)
    jobs = [(k, v, f, s) for (k, v), (f, s) in itertools.product(by_fit.items(), enumerate(sizes[-n_folds:]))]
    paths = [f"{folder}/depth={depth}-leaf={leaf}-cycle={validation}" for (depth, leaf), _, _, (validation, _) in jobs]
    open_ = [(j, p) for j, p in zip(jobs, paths, strict=True) if _landed_scores(spark, f"{p}/scores") is None]
    if open_:
        todo = [j for j, _ in open_]
        models = fit(
            rows, [k[0] for k, *_ in todo], [k[1] for k, *_ in todo], [max(s.rounds for s in v) for _, v, *_ in todo], seed,
            before=[(cycle, c) for *_, (c, _) in todo])
        tested = rows.join(F.broadcast(spark.createDataFrame([(c, f) for f, (c, _) in enumerate(sizes[-n_folds:])], [cycle, "_fold"])), cycle)
        errors = staged_errors(models, tested, [f for *_, f, _ in todo], [[s.rounds for s in v] for _, v, *_ in todo])
        for ((_, stages, fold, (_, size)), path), model, found in zip(open_, models, errors, strict=True):
            model.write().overwrite().save(f"{path}/trees")
            cells = [(s.order, s.name, fold, size, e, bool(np.isfinite(e))) for s, e in zip(stages, found, strict=True)]
            spark.createDataFrame(cells, SCORES).coalesce(1).write.mode("overwrite").parquet(f"{path}/scores")
    return spark.read.schema(SCORES).parquet(*(f"{p}/scores" for p in paths))


@dataclass(frozen=True)
class Ensemble:
    """Trees as nested (feature, threshold, left, right), leaves as numbers, each with its weight."""

    trees: list
    weights: list[float]
    thresholds: dict[int, np.ndarray]

    def predict(self, x: np.ndarray, feature: int | None = None, values: np.ndarray | None = None) -> np.ndarray:
        """Predictions of the rows of x, or of every row with every one of `values` in the feature's place."""
        sweep = None if feature is None else values[None, :]
        inputs = np.ascontiguousarray(x.T)
        inputs = list(inputs) if sweep is None else [c[:, None] for c in inputs]

        def walk(node):
            if not isinstance(node, tuple):
                return node
            f, threshold, left, right = node
            at = sweep if f == feature else inputs[f]
            return np.where(at <= threshold, walk(left), walk(right))

        total = np.zeros(len(x) if sweep is None else (len(x), len(values)))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total += weight * walk(tree)
        return total

    def using(self, feature: int) -> Ensemble:
        """The trees that split on an input: no other moves with it."""
        kept = [(t, w) for t, w in zip(self.trees, self.weights, strict=True) if feature in _thresholds([t])]
        return Ensemble([t for t, _ in kept], [w for _, w in kept], self.thresholds)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Assembled rows with a column `prediction`."""
        from pyspark.ml.functions import vector_to_array

        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return rows.withColumn("prediction", F.pandas_udf(predicted, "double")(vector_to_array("x")))

    def write(self) -> _Writer:
        return _Writer(self)


@dataclass(frozen=True)
class _Writer:
    """Saves a model's node table, as MLlib's writers do."""

    model: Ensemble
    mode: str = "error"

    def overwrite(self) -> _Writer:
        return _Writer(self.model, "overwrite")

    def save(self, path: str) -> None:
        def nodes(tree: int, weight: float, node, i: int) -> Iterator[tuple]:
            if not isinstance(node, tuple):
                yield tree, weight, i, None, None, node
                return
            yield tree, weight, i, node[0], node[1], None
            yield from nodes(tree, weight, node[2], 2 * i + 1)
            yield from nodes(tree, weight, node[3], 2 * i + 2)

        found = [r for k, (t, w) in enumerate(zip(self.model.trees, self.model.weights, strict=True)) for r in nodes(k, w, t, 0)]
        SparkSession.active().createDataFrame(found, NODES).coalesce(1).write.mode(self.mode).parquet(path)


def _thresholds(trees: list) -> dict[int, np.ndarray]:
    cuts: dict[int, set] = {}

    def visit(node) -> None:
        if isinstance(node, tuple):
            cuts.setdefault(node[0], set()).add(node[1])
            visit(node[2])
            visit(node[3])

    for t in trees:
        visit(t)
    return {f: np.array(sorted(v)) for f, v in cuts.items()}


def _ensemble(grown: list[tuple], edges: list[np.ndarray]) -> Ensemble:
    """Nested trees of a model's binned ones."""

    def build(tree: tuple, level: int, j: int):
        k, span = 2**level - 1 + j, len(tree[2]) >> level
        if span == 1 or tree[1][k] == NO_SPLIT:
            return float(tree[2][j * span])
        f = int(tree[0][k])
        return f, float(edges[f][tree[1][k]]), build(tree, level + 1, 2 * j), build(tree, level + 1, 2 * j + 1)

    trees = [build(t, 0, 0) for t in grown]
    return Ensemble(trees, [STEP if i else 1.0 for i in range(len(trees))], _thresholds(trees))


def ensemble(spark: SparkSession, path: str) -> Ensemble:
    """The trees of a saved model, read from its node table: at most rounds x 2^(depth + 1) rows."""
    nodes: dict[int, dict] = {}
    for r in spark.read.schema(NODES).parquet(path).collect():
        nodes.setdefault(r.tree, {})[r.node] = r

    def build(own: dict, i: int):
        n = own[i]
        return n.value if n.feature is None else (n.feature, n.threshold, build(own, 2 * i + 1), build(own, 2 * i + 2))

    trees = [build(nodes[t], 0) for t in sorted(nodes)]
    return Ensemble(trees, [nodes[t][0].weight for t in sorted(nodes)], _thresholds(trees))


def monotonicity_audit(rows: DataFrame, trees: Ensemble, columns: Sequence[str], signs: dict[str, int] = SIGNS, slack: float = 1e-12) -> DataFrame:
    """(feature, sign, thresholds, rows, moves, violations, violating_rows, largest): every step against a declared sign.

    With all other inputs of a row held, the model's output over one input is a step function that changes only
    where some tree splits on that input. So a row is read at one point between each two neighbouring
    thresholds, which finds every step there is. moves counts steps of any size, violations those
    against the sign by more than `slack`, largest is the largest of them. `rows` are assembled; nothing is
    exchanged but a few sums per task.
    """
    swept = [(j, c, signs[c]) for j, c in enumerate(columns) if signs.get(c, 0)]
    moving = {j: trees.using(j) for j, _, _ in swept}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: [0, 0, 0, 0, 0.0] for _, c, _ in swept}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(at, 1024)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                for j, c, sign in swept:
                    own = total[c]
                    own[0] += len(x)
                    if j in trees.thresholds:
                        step = sign * np.diff(moving[j].predict(x, j, np.append(trees.thresholds[j], np.inf)), axis=1)
                        wrong = step < -slack
                        own[1] += int((np.abs(step) > slack).sum())
                        own[2] += int(wrong.sum())
                        own[3] += int(wrong.any(axis=1).sum())
                        own[4] = max(own[4], float(-step.min(initial=0.0)))
        names = [c for _, c, _ in swept]
        columns_ = [pa.array(names), *(pa.array([total[c][k] for c in names], pa.float64() if k == 4 else pa.int64()) for k in range(5))]
        yield pa.RecordBatch.from_arrays(columns_, names=["feature", "n", "m", "v", "r", "w"])

    from pyspark.ml.functions import vector_to_array

    found = rows.select(vector_to_array("x").alias("x")).mapInArrow(sums, "feature string, n bigint, m bigint, v bigint, r bigint, w double")
    facts = rows.sparkSession.createDataFrame(
        [(c, sign, len(trees.thresholds.get(j, ()))) for j, c, sign in swept], "feature string, sign int, thresholds int")
    return found.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum("m").alias("moves"), F.sum("v").alias("violations"), F.sum("r").alias("violating_rows"),
        F.max("w").alias("largest"),
    ).join(F.broadcast(facts), "feature").select(
        "feature", "sign", "thresholds", "rows", "moves", "violations", "violating_rows",
        F.when(F.col("violations") > 0, F.col("largest")).otherwise(0.0).alias("largest"))
