"""Baselines, metrics, paired cluster bootstrap and residual reports as long DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.functions.ranks import dense_index, exact_median, exact_quantiles

BASELINES = ("train_median", "train_mean", "train_median_by_position")


def with_baselines(test: DataFrame, train: DataFrame, label: str, group: str) -> DataFrame:
    """Test rows with the three train-only baselines; a group unseen in training falls back.

    Medians are exact. ``group`` must be a closed set (positions): its medians are broadcast.
    """
    med = exact_median(train, label, "train_median").scalar()
    mean = train.agg(F.avg(label)).scalar()
    per_group = exact_median(train, label, "group_median", [group])
    return (
        test.join(F.broadcast(per_group), group, "left")
        .withColumn("train_median", med)
        .withColumn("train_mean", mean)
        .withColumn("group_fallback", F.col("group_median").isNull())
        .withColumn("train_median_by_position", F.coalesce("group_median", "train_median"))
        .drop("group_median")
    )


def long_errors(
    df: DataFrame, keep: Sequence[str], label: str, methods: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """One row per (row, method): label, prediction, unclamped log prediction, absolute error.

    methods maps a name to (prediction in units, log prediction).
    """
    cells = [
        F.struct(F.lit(m).alias("method"), p.cast("double").alias("pred"), g.alias("pred_log"))
        for m, (p, g) in methods.items()
    ]
    return (
        df.select(*keep, F.col(label).cast("double").alias("y"), F.explode(F.array(*cells)).alias("m"))
        .select(*keep, "y", "m.*")
        .withColumn("abs_err", F.abs(F.col("y") - F.col("pred")))
    )


def metrics(long: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """MAE, median AE, RMSE, log MAE, R2 (null for a constant label) and rows per method.

    All but the exact median come from one map-side combined aggregate.
    """
    by = list(by)
    sq = F.pow(F.col("y") - F.col("pred"), 2)
    n = F.count(F.lit(1))
    total = F.var_pop("y") * n
    base = long.groupBy(*by).agg(
        F.avg("abs_err").alias("mae"),
        F.sqrt(F.avg(sq)).alias("rmse"),
        F.avg(F.abs(F.log1p("y") - F.col("pred_log"))).alias("log_mae"),
        F.when(total > 0, 1 - F.sum(sq) / total).alias("r2"),
        n.alias("rows"),
    )
    med = exact_median(long, "abs_err", "median_ae", by)
    return base.join(med, by, "left")


def cluster_sums(df: DataFrame, cluster: str, errors: dict[str, Column]) -> DataFrame:
    """Rows and summed absolute error per cluster: all the bootstrap needs of the rows."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("_rows"), *(F.sum(e).alias(m) for m, e in errors.items())
    )


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities, as far as 52 bits tell them apart."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 18):
        total += term
        out.append(total)
        term /= k
    return out


#: Cluster counts one task makes, about.
COUNTS_PER_TASK = 1_000_000


def _spread(sums: DataFrame, clusters: int, replicates: int) -> DataFrame:
    """Cluster sums over as many tasks as their counts in all replicates need."""
    return sums.repartition(max(1, min(clusters, -(-clusters * replicates // COUNTS_PER_TASK))))


def poisson_count(digest: Column) -> Column:
    """Poisson(1) number of an md5 text: the steps that its first 13 hex digits, as a share of 16^13, have reached.

    Hex digits of one length sort like their numbers, so the text is compared as it is; most counts are 0 or 1 and
    need a comparison or two.
    """
    steps = [format(math.ceil(c * 16**13), "013x") for c in poisson_steps() if c < 1]
    return reduce(lambda later, k: F.when(digest < steps[k], k).otherwise(later), reversed(range(len(steps))), F.lit(len(steps)))


def _poisson_sums(sums: DataFrame, cluster: str, errors: list[str], replicates: int, seed: int) -> DataFrame:
    draw = F.md5(F.concat_ws("|", F.col("_rep").cast("string"), "_key", F.lit(str(seed))))
    keyed = _spread(sums.withColumn("_key", F.col(cluster).cast("string")), sums.count(), replicates)
    rows = keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep")).withColumn("_u", draw)
    weight = poisson_count(F.col("_u"))
    # Rows of weight 0 stay: a filter on the weight would hash once per step of it, below the projection.
    return rows.withColumn("_w", weight).groupBy("_rep").agg(
        F.sum(F.col("_w") * F.col("_rows")).alias("_n"), *(F.sum(F.col("_w") * F.col(m)).alias(m) for m in errors)).where("_n > 0")


# Multiplier and mask of the 32-bit mixing steps.
MIX, LOW32 = 73244475, 0xFFFFFFFF
#: Poisson counts leave about this many standard deviations of draws to be drawn one by one.
MARGIN = 8.0


def _mixed(df: DataFrame, x: Column, out: str) -> DataFrame:
    """Add a 32-bit hash of x (0 to 2^32 - 1) in plain integer arithmetic, a column per step."""
    df = df.withColumn(out, x)
    fold = F.shiftright(out, 16).bitwiseXOR(F.col(out))
    for _ in range(2):
        df = df.withColumn(out, (fold * MIX).bitwiseAND(LOW32))
    return df.withColumn(out, fold)


def _drawn(df: DataFrame, seed: int, place: str, out: str) -> DataFrame:
    """Add a hash of (_rep, place, seed)."""
    df = _mixed(df, (F.col("_rep") + seed * 65537).bitwiseAND(LOW32), "_own")
    slot = (F.col(place) + F.shiftright(place, 32) * MIX).bitwiseAND(LOW32)
    return _mixed(df, F.col("_own").bitwiseXOR(slot), out).drop("_own")


def thinned_steps(clusters: int) -> list[int]:
    """Cumulative Poisson probabilities in units of 2^-32, for a mean so far below 1 that all clusters' counts
    add up to less than the number of clusters."""
    mean = max(0.0, 1 - MARGIN / math.sqrt(clusters)) if clusters else 0.0
    terms = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(17)]
    return [math.floor(sum(terms[: k + 1]) * 2**32) for k in range(17)]


def _multinomial_sums(sums: DataFrame, cluster: str, errors: list[str], replicates: int, seed: int) -> DataFrame:
    """Rows and errors of every replicate's draws: as many clusters as there are, with replacement.

    Most draws need no lookup. Independent Poisson counts per cluster, given their total, are that many draws;
    with a mean below 1 the total stays below the number of clusters, and what is missing is drawn
    one by one. So a task counts its own clusters for all replicates and sends one row per replicate, and only
    about MARGIN * sqrt(clusters) draws per replicate meet the cluster sums in a join.
    """
    indexed = land(dense_index(sums, cluster, "_slot", "_clusters").select("_slot", "_rows", *errors), "clusters")
    clusters = indexed.count()
    reps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("_rep")
    rows = _drawn(_spread(indexed, clusters, replicates).select("*", reps), seed, "_slot", "_h")
    weight = reduce(lambda x, y: x + y, [(F.col("_h") >= c).cast("int") for c in thinned_steps(clusters)])
    counted = rows.withColumn("_w", weight).groupBy("_rep").agg(
        F.sum("_w").alias("_draws"), F.sum(F.col("_w") * F.col("_rows")).alias("_n"), *(F.sum(F.col("_w") * F.col(m)).alias(m) for m in errors))
    counted = land(counted, "counted")  # one row per replicate
    left = F.lit(clusters) - F.col("_draws")
    left = F.when(left >= 0, left).otherwise(F.raise_error(F.lit("more draws than clusters")).cast("long"))
    tasks = -(-replicates * int(MARGIN * math.sqrt(clusters) + 1) // COUNTS_PER_TASK)
    singles = counted.select("_rep", left.alias("_left")).repartition(max(1, min(replicates, tasks))).where("_left > 0").select("_rep", F.explode(F.sequence(F.lit(1).cast("long"), "_left")).alias("_draw"))
    # Never null, so that no filter on the whole chain of steps is derived from the join.
    slot = F.coalesce(F.shiftright(F.col("_h") * clusters, 32), F.lit(-1))
    singles = _drawn(singles, seed + 1, "_draw", "_h").select("_rep", slot.alias("_slot"))
    # Spark takes the draws for as few rows as there are replicates and would broadcast them.
    single = singles.hint("merge").join(indexed, "_slot").groupBy("_rep").agg(F.sum("_rows").alias("_n"), *(F.sum(m).alias(m) for m in errors))
    return counted.drop("_draws").unionByName(single).groupBy("_rep").agg(F.sum("_n").alias("_n"), *(F.sum(m).alias(m) for m in errors))


def paired_cluster_bootstrap(
    df: DataFrame,
    cluster: str,
    errors: dict[str, Column],
    reference: str,
    replicates: int,
    seed: int,
    confidence: float,
    weights: str = "multinomial",
) -> DataFrame:
    """Per comparison: observed MAE difference to ``reference``, its percentile interval, verdict.

    Every replicate draws as many clusters as there are, with replacement, and all methods use
    the same draws. Draws hash (replicate, place, seed), so results do not depend on partitioning. See
    ``_multinomial_sums`` for how few of them are joined.

    With weights="poisson" a cluster counts in a replicate as often as a Poisson(1) number from
    md5(replicate|cluster|seed) says, which is the limit of the draws for many clusters. Nothing is
    joined then: every task sums its own clusters and sends one row per replicate.
    """
    others = [m for m in errors if m != reference]
    sums = land(cluster_sums(df, cluster, errors), "cluster-sums")
    if weights == "poisson":
        drawn = _poisson_sums(sums, cluster, list(errors), replicates, seed)
    else:
        drawn = _multinomial_sums(sums, cluster, list(errors), replicates, seed)
    delta = drawn.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(m).alias("comparison"),
                        ((F.col(reference) - F.col(m)) / F.col("_n")).alias("delta"),
                    )
                    for m in others
                )
            )
        ).alias("x")
    ).select("x.*")
    tail = (1 - confidence) / 2
    ci = delta.groupBy("comparison").agg(  # one value per replicate
        F.percentile("delta", F.lit(tail)).alias("ci_low"),
        F.percentile("delta", F.lit(1 - tail)).alias("ci_high"),
    )
    whole = sums.agg(
        F.sum("_rows").alias("_n"),
        F.max("_rows").alias("_most"),
        F.count(F.lit(1)).alias("clusters"),
        *(F.sum(m).alias(m) for m in errors),
    ).select(
        "clusters",
        F.when(F.col("_most") > 1, "cluster").otherwise("row").alias("resampling_unit"),
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(m).alias("comparison"),
                        ((F.col(reference) - F.col(m)) / F.col("_n")).alias("observed_delta"),
                    )
                    for m in others
                )
            )
        ).alias("x"),
    ).select("clusters", "resampling_unit", "x.*")
    # The reference's error against the other's, where the interval leaves zero out.
    verdict = F.when(F.col("ci_high") < 0, "lower").when(F.col("ci_low") > 0, "higher").otherwise("unclear")
    return whole.join(F.broadcast(ci), "comparison").withColumn("verdict", verdict)


def worst_k(df: DataFrame, error: str, key: str, k: int = 5) -> DataFrame:
    """k largest errors, ties by key. Each task keeps k rows."""
    return df.orderBy(F.desc(error), F.asc(key)).limit(k)


def prediction_table(
    df: DataFrame, keep: Sequence[str], label: str, methods: dict[str, tuple[Column, Column]], chosen: str
) -> DataFrame:
    """One row per test row with every method's prediction and the chosen method's residual."""
    pred, log = methods[chosen]
    return df.select(
        *keep,
        *(p.alias(f"pred__{m}") for m, (p, _) in methods.items()),
        log.alias("prediction_log"),
        pred.alias("prediction"),
        (F.col(label) - pred).alias("residual"),
        F.abs(F.col(label) - pred).alias("abs_error"),
    )


def residual_overview(pred: DataFrame, label: str) -> DataFrame:
    """One row: share under-predicted, mean and median residual, mean log residual."""
    agg = pred.agg(
        F.avg((F.col("residual") > 0).cast("double")).alias("share_underpredicted"),
        F.avg("residual").alias("mean_residual"),
        F.avg(F.log1p(label) - F.col("prediction_log")).alias("mean_log_residual"),
    )
    med = exact_median(pred, "residual", "median_residual").scalar()
    return agg.withColumn("median_residual", med)


def residuals_by_group(pred: DataFrame, group: str) -> DataFrame:
    agg = pred.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("abs_error").alias("mae")
    )
    return agg.join(exact_median(pred, "residual", "median_residual", [group]), group)


def drift_by_cycle(df: DataFrame, cycle: str, label: str, log_residual: Column) -> DataFrame:
    """(cycle, partition, rows, mean log residual, median label): in-sample for train rows."""
    groups = [cycle, "partition"]
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(log_residual).alias("mean_log_residual")
    )
    return agg.join(exact_median(df, label, "median_label", groups), groups)


def group_means(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *(F.avg(c).alias(n) for n, c in columns.items())
    )


def share_positive(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(
        *(F.avg((F.col(c) > 0).cast("double")).alias(f"share_{c}") for c in columns)
    )


def median_level_by_cycle(df: DataFrame, cycle: str, log_level: str) -> DataFrame:
    return exact_median(df, log_level, "_m", [cycle]).select(
        cycle, F.exp("_m").alias("median_level")
    )


def status_overview(rows: DataFrame, label: str) -> DataFrame:
    """Comparator match: rows per status, median age of matched rows, share above the comparator."""
    counts = rows.groupBy("market_value_status").agg(F.count(F.lit(1)).alias("rows"))
    matched = rows.where("market_value_status = 'matched'")
    age = exact_median(matched, "valuation_age_days", "median_age").scalar()
    above = matched.agg(
        F.avg((F.col(label) > F.col("market_value_eur")).cast("double"))
    ).scalar()
    return counts.withColumn("median_age", age).withColumn("share_label_above", above)


def replicate_interval(delta: DataFrame, value: str, confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    return exact_quantiles(delta, value, {"ci_low": tail, "ci_high": 1 - tail})
