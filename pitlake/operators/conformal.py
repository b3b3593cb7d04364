"""Split-conformal intervals and compression diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.ranks import exact_median, exact_quantiles, rank_select
from pitlake.operators import learn as M


def out_of_fold(
    train: DataFrame, cv: M.FoldFits, variant: str, grid_order: int, cycle: str, label: str
) -> DataFrame:
    """Validation rows with their fold and residual label - prediction of the fold's own fit."""
    pred, fold = F.lit(None).cast("double"), F.lit(None).cast("int")
    for f, val in enumerate(cv.validation_cycles):
        here = F.col(cycle) == val
        pred = F.when(here, M.prediction(cv.fits[variant][grid_order][f])).otherwise(pred)
        fold = F.when(here, F.lit(f)).otherwise(fold)
    rows = train.where(F.col(cycle).isin(*cv.validation_cycles))
    return rows.withColumn("fold", fold).withColumn("oof_residual", F.col(label) - pred)


def conformal_quantile(
    scores: DataFrame, score: str, levels: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(level, calibration rows, q): the ceil((n+1) level)-th smallest score, infinite if past n."""
    names = {f"q{i}": level for i, level in enumerate(levels)}
    ranks = {
        n: (lambda rows, lv=lv: F.ceil((rows + 1).cast("double") * F.lit(float(lv))) - 1)
        for n, lv in names.items()
    }
    # One rank that always exists keeps the row when every wanted rank is past the end.
    found = rank_select(scores, score, {**ranks, "_first": lambda rows: F.lit(0)}, by)
    cells = [
        F.struct(
            F.lit(float(lv)).alias("level"),
            F.col("n").alias("calibration_rows"),
            F.coalesce(F.col(n), F.lit(float("inf"))).alias("q_log"),
        )
        for n, lv in names.items()
    ]
    return found.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")


def interval(pred_log: Column, q: Column) -> tuple[Column, Column]:
    return F.greatest(F.expm1(pred_log - q), F.lit(0.0)), F.expm1(pred_log + q)


def coverage(df: DataFrame, residual: Column, q: Column, by: Sequence[str] = ()) -> DataFrame:
    r = residual
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.abs(r) <= q).cast("double")).alias("coverage"),
        F.avg((r > q).cast("double")).alias("share_above_upper"),
        F.avg((r < -q).cast("double")).alias("share_below_lower"),
    )


def with_levels(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Rows once per interval level (a handful, from the levels argument) with its q."""
    pairs = quantiles.agg(F.collect_list(F.struct("level", "q_log")).alias("a")).scalar()
    return df.withColumn("_l", F.explode(pairs)).select(*df.columns, "_l.*")


def coverage_report(
    test: DataFrame, quantiles: DataFrame, label: str, pred_log: str, groups: Sequence[str]
) -> DataFrame:
    """Coverage per level overall and per value of each grouping column, in one aggregate."""
    rows = with_levels(test, quantiles)
    cells = [F.struct(F.lit("all").alias("item"), F.lit("all").alias("value"))]
    cells += [
        F.struct(F.lit(g).alias("item"), F.col(g).cast("string").alias("value")) for g in groups
    ]
    spread = rows.withColumn("_g", F.explode(F.array(*cells))).select(
        "level", "q_log", "_g.*", (F.log1p(label) - F.col(pred_log)).alias("_r")
    )
    return coverage(spread, F.col("_r"), F.col("q_log"), ["level", "item", "value"])


def interval_medians(test: DataFrame, quantiles: DataFrame, pred_log: str) -> DataFrame:
    """Per level: width factor exp(q) and the medians of prediction, lower and upper bound."""
    lo, hi = interval(F.col(pred_log), F.col("q_log"))
    rows = with_levels(test, quantiles).select(
        "level", F.expm1(pred_log).alias("_p"), lo.alias("_lo"), hi.alias("_hi")
    )
    out = quantiles.withColumn("factor", F.exp("q_log"))
    for c, name in (("_p", "median_prediction"), ("_lo", "median_lower"), ("_hi", "median_upper")):
        out = out.join(F.broadcast(exact_median(rows, c, name, ["level"])), "level", "left")
    return out


def compression(test: DataFrame, label: str, pred_log: str, key: str) -> DataFrame:
    """How far predictions reach towards the largest labels (ties on the label: smallest key)."""
    y_log = F.log1p(label)
    cut = exact_quantiles(test.withColumn("_yl", y_log), "_yl", {"c": 0.9}).select("c").scalar()
    top = y_log >= cut
    varied = F.max(pred_log) > F.min(pred_log)
    largest = F.min_by(F.struct(label, pred_log), F.struct(-F.col(label), F.col(key)))
    return (
        test.agg(
            F.expm1(F.max(pred_log)).alias("max_prediction"),
            largest.alias("_big"),
            F.count(F.when(top, 1)).alias("top_decile_rows"),
            F.avg(F.when(top, y_log - F.col(pred_log))).alias("top_decile_mean_log_residual"),
            F.when(varied, F.regr_slope(y_log, F.col(pred_log))).alias("calibration_slope"),
        )
        .withColumn("largest_label", F.col(f"_big.{label}"))
        .withColumn("prediction_for_largest", F.expm1(F.col(f"_big.{pred_log}")))
        .drop("_big")
    )
