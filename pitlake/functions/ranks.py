"""Exact order statistics without gathering a group in one task.

A monotone bucket of the value is counted per group (map-side combined, so only bucket counts
travel). Running totals over the bucket counts tell which bucket holds each wanted rank; only
that bucket's values are read again, collapsed to (value, count), and dealt into equal steps between
its least and largest value, so values packed in a narrow range are told apart too. Only the step that
holds the rank is walked. Every window here runs over bucket or step counts, or over the distinct
values of one step, never over raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 2048
STEPS = 4096


def value_bucket(v: Column, per_e_fold: int = BUCKETS_PER_E_FOLD) -> Column:
    """Non-decreasing in v: equal steps on a signed log scale that is linear below 1e-6."""
    size = F.floor(F.log1p(F.abs(v) * 1e6) * per_e_fold)
    return F.when(v < 0, -size).otherwise(size).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def rank_select(
    df: DataFrame,
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
    few_groups: bool = False,
    with_offset: bool = False,
) -> DataFrame:
    """Value at given 0-based ascending ranks, per group. One row per group.

    ranks maps an output name to a function of the group's row count; it may also use the
    ``by`` columns. Null and NaN values are left out. A rank outside [0, n) gives null.
    few_groups says the groups are a closed set (folds, positions, methods): the selected
    buckets, at most groups x ranks rows, are then broadcast. with_offset adds the position of
    the rank among equal values.
    """
    by = list(by)
    names = list(ranks)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_b", value_bucket(F.col("_v")))

    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        rows.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("n", F.sum("_c").over(group))
        .withColumn("_start", F.sum("_c").over(running) - F.col("_c"))
    )
    for name in names:
        hist = hist.withColumn(f"_r_{name}", ranks[name](F.col("n")).cast("bigint"))
    inside = [
        (F.col(f"_r_{n}") >= F.col("_start")) & (F.col(f"_r_{n}") < F.col("_start") + F.col("_c"))
        for n in names
    ]
    chosen = hist.where(reduce(lambda a, b: a | b, inside)).drop("_c")
    keys = [F.col(c).alias(f"_k_{c}") for c in by]
    chosen = chosen.select(
        *keys, F.col("_b").alias("_kb"), "_low", "_high", "_start", "n", *(f"_r_{n}" for n in names)
    )
    if few_groups:
        chosen = F.broadcast(chosen)
    match = rows["_b"] == chosen["_kb"]
    for c in by:
        match = match & rows[c].eqNullSafe(chosen[f"_k_{c}"])
    place = [*by, "_b", "_step"]
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    cells = (
        rows.join(chosen, match)
        .withColumn("_step", F.when(F.col("_high") > F.col("_low"), F.floor(share * STEPS)).otherwise(0))
        .groupBy(*place, "_start", "n", *(f"_r_{n}" for n in names), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    before = Window.partitionBy(*by, "_b").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        cells.groupBy(*place, "_start", *(f"_r_{n}" for n in names)).agg(F.sum("_c").alias("_sc"))
        .withColumn("_to", F.col("_start") + F.sum("_sc").over(before))
        .withColumn("_at", F.col("_to") - F.col("_sc"))
    )
    holds = [(F.col(f"_r_{n}") >= F.col("_at")) & (F.col(f"_r_{n}") < F.col("_to")) for n in names]
    steps = steps.where(reduce(lambda x, y: x | y, holds)).select(*(F.col(c).alias(f"_s{c}") for c in place), "_at")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in place])
    cells = cells.join(F.broadcast(steps) if few_groups else steps, same).drop(*(f"_s{c}" for c in place))
    walk = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_end", F.col("_at") + F.sum("_c").over(walk)).withColumn(
        "_from", F.col("_end") - F.col("_c")
    )
    out = [F.max("n").alias("n")]
    for n in names:
        hit = (F.col(f"_r_{n}") >= F.col("_from")) & (F.col(f"_r_{n}") < F.col("_end"))
        out.append(F.max(F.when(hit, F.col("_v"))).alias(n))
        if with_offset:
            out.append(F.max(F.when(hit, F.col(f"_r_{n}") - F.col("_from"))).alias(f"{n}_offset"))
    return cells.groupBy(*by).agg(*out)


def _pos(n: Column, p: float) -> Column:
    return F.lit(float(p)) * (n - 1).cast("double")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles (same definition as ``percentile``), one row per group."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"{name}__lo"] = lambda n, p=p: F.floor(_pos(n, p))
        ranks[f"{name}__hi"] = lambda n, p=p: F.ceil(_pos(n, p))
    sel = rank_select(df, value, ranks, by, few_groups)
    cols = []
    for name, p in probs.items():
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        frac = _pos(F.col("n"), p) - F.floor(_pos(F.col("n"), p))
        cols.append((lo + (hi - lo) * frac).alias(name))
    return sel.select(*by, F.col("n").alias("n_values"), *cols)


def exact_median(
    df: DataFrame, value: str, out: str, by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    return exact_quantiles(df, value, {out: 0.5}, by, few_groups).drop("n_values")


def equal_count_bands(df: DataFrame, value: str, key: str, k: int, out: str = "band") -> DataFrame:
    """Add a 1-based band of k near-equal counts by ascending value (first n mod k get one more).

    Equal values are ordered by a hash of the key. Only the k-1 cut points are looked up; rows
    then compare themselves with those, so there is no global sort or single-task window. A value
    shared by a third of all rows is cut by its hash, again through counts.
    """
    tie = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("double")
    rows = df.withColumn("_tie", tie)
    ranks = {
        f"c{i}": (lambda n, i=i: F.floor(n / k) * i + F.least(n % k, F.lit(i)))
        for i in range(1, k)
    }
    cuts = rank_select(rows, value, ranks, few_groups=True, with_offset=True)
    cuts = cuts.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(i).alias("i"),
                        F.col(f"c{i}").alias("cut"),
                        F.col(f"c{i}_offset").alias("offset"),
                    )
                    for i in range(1, k)
                )
            )
        ).alias("x")
    ).select("x.*").where("cut is not null")
    tied = rows.join(F.broadcast(cuts), rows[value].cast("double") == cuts["cut"]).select(
        "i", "cut", "offset", "_tie"
    )
    at = rank_select(tied, "_tie", {"tie": lambda n: F.col("offset")}, ["i", "cut", "offset"], few_groups=True)
    found = sorted((r.cut, r.tie) for r in at.select("cut", "tie").collect())  # at most k - 1 rows
    bounds = F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(x).alias("tie")) for c, x in found))
    bounds = bounds if found else F.expr("cast(array() as array<struct<cut:double,tie:double>>)")
    own = F.struct(F.col(value).cast("double").alias("cut"), F.col("_tie").alias("tie"))
    rows = rows.withColumn("_bounds", bounds).withColumn("_own", own)
    passed = F.filter("_bounds", lambda b: b <= F.col("_own"))
    return rows.withColumn(out, (1 + F.size(passed)).cast("int")).drop("_tie", "_bounds", "_own")


def dense_index(df: DataFrame, key: str, out: str, total: str, hex_digits: int = 3) -> DataFrame:
    """0-based dense index of unique keys in (md5, key) order, plus the key count.

    Rows are numbered inside 16^hex_digits md5 buckets and shifted by the counts before them;
    the broadcast offsets are at most 16^hex_digits rows whatever the data size.
    """
    md5 = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("_md5", md5).withColumn("_bucket", F.substring("_md5", 1, hex_digits))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0))
    before = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(
        F.col("_bucket"),
        (F.sum("_c").over(before) - F.col("_c")).alias("_off"),
        F.sum("_c").over(w).alias(total),
    )
    inner = Window.partitionBy("_bucket").orderBy("_md5", key)
    return (
        rows.withColumn("_rn", F.row_number().over(inner))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
        .drop("_bucket", "_md5", "_rn", "_off")
    )
