"""Label rules, the exclusion funnel and the round-trip diagnostic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import FEATURE_REASONS, first_reason

# Reasons a move is not a label, in test order.
LABEL_REASONS = (
    "missing_player_id",
    "missing_transfer_date",
    "outside_study_window",
    "undisclosed_fee",
    "malformed_fee",
    "zero_fee_free_or_loan",
)

# Funnel step reached once a reason's rows are gone.
STEP_OF_REASON = {
    "missing_player_id": "valid_player_ids",
    "missing_transfer_date": "valid_transfer_dates",
    "outside_study_window": "in_study_window",
    "undisclosed_fee": "fee_field_present",
    "malformed_fee": "fee_well_formed",
    "zero_fee_free_or_loan": "positive_reported_fee",
    "no_lookback_coverage": "lookback_coverage_available",
    "no_league_appearances_in_lookback": "league_active_candidates",
    "insufficient_lookback_minutes": "sufficient_lookback_minutes",
    "invalid_per90": "valid_per90_features",
    "missing_age": "usable_age",
    "missing_position": "usable_position",
}
IMPLIED_STEPS = ("classified_permanent", "classified_non_loan", "unique_transfer_identity")


def label_reason(start: Column, end_exclusive: Column) -> Column:
    """First failing label rule of a move, null for a valid label."""
    d, fc = F.col("transfer_date"), F.col("fee_class")
    failing = (
        F.col("player_id").isNull(),
        d.isNull(),
        (d < start) | (d >= end_exclusive),
        fc == "undisclosed",
        fc == "malformed",
        fc == "zero_fee",
    )
    return first_reason(list(zip(LABEL_REASONS, failing, strict=True)))


def with_label_reason(moves: DataFrame, start: Column, end_exclusive: Column) -> DataFrame:
    return moves.withColumn("label_exclusion_reason", label_reason(start, end_exclusive))


def labels(with_reason: DataFrame) -> DataFrame:
    """Rows without a reason, plus the log label. A label without a positive fee fails the job."""
    fee = F.col("fee_eur")
    good = fee.isNotNull() & (fee > 0) & (fee < float("inf"))
    bad = F.raise_error(F.lit("label row without a positive finite fee")).cast("double")
    return (
        with_reason.where("label_exclusion_reason is null")
        .drop("label_exclusion_reason")
        .withColumn("fee_log1p", F.when(good, F.log1p(fee)).otherwise(bad))
    )


def label_stats(with_reason: DataFrame) -> DataFrame:
    """(scope, item, rows): all rows by reason, and study-window totals per fee class."""
    r = F.coalesce("label_exclusion_reason", F.lit("labeled"))
    in_window = ~r.isin(*LABEL_REASONS[:3])
    counted = with_reason.groupBy(r.alias("item"), "fee_class", in_window.alias("_in")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    everything = counted.groupBy("item").agg(F.sum("rows").alias("rows"))
    window = counted.where("_in").groupBy(F.col("fee_class").alias("item")).agg(
        F.sum("rows").alias("rows")
    )
    return everything.select(F.lit("all_rows").alias("scope"), "item", "rows").unionByName(
        window.select(F.lit("study_window").alias("scope"), "item", "rows")
    )


def round_trips(
    labeled: DataFrame, moves: DataFrame, key: str = "transfer_id", days: int = 400
) -> DataFrame:
    """Labels followed within (0, days] by a zero or undisclosed move back to the seller.

    Null clubs match null clubs. Moves back collapse to one row per (player, clubs, day); a
    forward range frame then asks whether one lies ahead, so moves are never paired up.
    """
    route = ["player_id", "_from", "_to"]
    back = (
        moves.where(F.col("fee_class").isin("zero_fee", "undisclosed"))
        .where("player_id is not null and transfer_date is not null")
        .select(
            "player_id",
            F.col("to_club_id").alias("_from"),
            F.col("from_club_id").alias("_to"),
            F.col("transfer_date").alias("_day"),
        )
        .distinct()
        .withColumn("_back", F.lit(1))
    )
    out = labeled.withColumn("_from", F.col("from_club_id")).withColumn("_to", F.col("to_club_id"))
    marks = out.select(*route, F.col("transfer_date").alias("_day")).distinct()
    ahead = Window.partitionBy(*route).orderBy(F.unix_date("_day")).rangeBetween(1, days)
    seen = (
        back.unionByName(marks.withColumn("_back", F.lit(None).cast("int")))
        .withColumn("_hit", F.max("_back").over(ahead))
        .where("_back is null and _hit is not null")
        .select(*(F.col(c).alias(f"_k{c}") for c in route), F.col("_day").alias("_kday"))
    )
    on = out["transfer_date"] == seen["_kday"]
    for c in route:
        on = on & out[c].eqNullSafe(seen[f"_k{c}"])
    return out.join(seen, on, "left_semi").drop("_from", "_to")


def funnel(
    with_reason: DataFrame, candidates: DataFrame, train_before: Column
) -> DataFrame:
    """Ordered steps with rows remaining, rows dropped and the reason, closed by train + test."""
    reasons = with_reason.groupBy(F.col("label_exclusion_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    later = candidates.groupBy(F.col("feature_exclusion_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    dropped = reasons.where("reason is not null").unionByName(later.where("reason is not null"))
    spark = with_reason.sparkSession
    names: list[tuple[int, str, str | None]] = [(0, "raw_transfer_rows_after_exact_dedup", None)]
    for reason in LABEL_REASONS:
        names.append((len(names), STEP_OF_REASON[reason], reason))
    for step in IMPLIED_STEPS:
        names.append((len(names), step, None))
    for reason in FEATURE_REASONS:
        names.append((len(names), STEP_OF_REASON[reason], reason))
    names.append((len(names), "final_supervised_rows", None))
    steps = spark.createDataFrame(names, "pos int, step string, reason string")
    total = with_reason.agg(F.count(F.lit(1))).scalar()
    w = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = (
        steps.join(dropped, "reason", "left")
        .withColumn("dropped", F.coalesce("_n", F.lit(0)).cast("bigint"))
        .withColumn("rows", total - F.sum("dropped").over(w))
        .select("pos", "step", "rows", "dropped", "reason")
    )
    ok = candidates.where("feature_exclusion_reason is null")
    sides = ok.agg(
        F.count(F.when(F.col("transfer_date") < train_before, 1)).alias("a"),
        F.count(F.when(F.col("transfer_date") >= train_before, 1)).alias("b"),
    )
    n = len(names)
    tail = sides.select(
        F.explode(
            F.array(
                F.struct(F.lit(n).alias("pos"), F.lit("train_rows").alias("step"), F.col("a").alias("rows")),
                F.struct(
                    F.lit(n + 1).alias("pos"), F.lit("test_rows").alias("step"), F.col("b").alias("rows")
                ),
            )
        ).alias("x")
    ).select(
        "x.*", F.lit(0).cast("bigint").alias("dropped"), F.lit(None).cast("string").alias("reason")
    )
    return body.unionByName(tail)


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(item, value, rows) for each listed column, in one scan."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in columns)
    )
    return (
        df.select(F.explode(pairs).alias("x"))
        .groupBy("x.item", "x.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
