"""Summary facts behind the charts: bands, worst misses, largest labels, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.ranks import equal_count_bands, exact_quantiles
from pitlake.operators.conformal import coverage
from pitlake.operators.evaluate import worst_k


def residual_bands(pred: DataFrame, label: str, key: str, k: int = 6) -> DataFrame:
    """Equal-count bands by prediction: rows, range, median and IQR of the log residual."""
    rows = equal_count_bands(
        pred.select(
            key, "prediction", (F.log1p(label) - F.col("prediction_log")).alias("_r")
        ),
        "prediction",
        key,
        k,
    )
    agg = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("prediction").alias("predicted_min"),
        F.max("prediction").alias("predicted_max"),
    )
    q = exact_quantiles(rows, "_r", {"_q1": 0.25, "median_log_residual": 0.5, "_q3": 0.75}, ["band"])
    return agg.join(F.broadcast(q.drop("n_values")), "band").select(
        "band", "rows", "predicted_min", "predicted_max", "median_log_residual",
        (F.col("_q3") - F.col("_q1")).alias("iqr_log"),
    )


def coverage_quarters(pred: DataFrame, label: str, key: str, q: Column, k: int = 4) -> DataFrame:
    rows = equal_count_bands(
        pred.select(key, "prediction", (F.log1p(label) - F.col("prediction_log")).alias("_r")),
        "prediction",
        key,
        k,
    )
    ends = rows.groupBy("band").agg(
        F.min("prediction").alias("predicted_min"), F.max("prediction").alias("predicted_max")
    )
    return coverage(rows, F.col("_r"), q, ["band"]).join(F.broadcast(ends), "band")


def worst_with_flags(
    pred: DataFrame, label: str, key: str, q: Column, k: int = 5, keep: Sequence[str] = ()
) -> DataFrame:
    """k worst rows with log residual and whether the label lies above the interval."""
    r = F.log1p(label) - F.col("prediction_log")
    return worst_k(pred, "abs_error", key, k).select(
        key, *keep, label, "prediction", r.alias("log_residual"), (r > q).alias("above_upper")
    )


def largest_labels(
    pred: DataFrame, bounds: DataFrame, label: str, key: str, n: int = 25, worst: int = 5
) -> DataFrame:
    """Rows with the n largest labels, their interval, coverage, and membership in the worst rows.

    The n rows are chosen first, so the interval join touches n keys only.
    """
    top = pred.orderBy(F.desc(label), F.asc(key)).limit(n)
    worst_keys = worst_k(pred, "abs_error", key, worst).select(
        F.col(key).alias("_w"), F.lit(True).alias("_hit")
    )
    return (
        bounds.join(F.broadcast(top), key)
        .join(F.broadcast(worst_keys), F.col(key) == F.col("_w"), "left")
        .withColumn("covered", (F.col(label) >= F.col("lower")) & (F.col(label) <= F.col("upper")))
        .withColumn("above_prediction", F.col(label) > F.col("prediction"))
        .withColumn("in_worst", F.coalesce("_hit", F.lit(False)))
        .drop("_w", "_hit")
    )


def compare_worst(
    pred: DataFrame, others: DataFrame, key: str, k: int, columns: Sequence[str]
) -> DataFrame:
    """The k worst rows of one model next to the other models' values for them."""
    worst = worst_k(pred, "abs_error", key, k).select(key, *columns)
    return others.join(F.broadcast(worst), key)
