"""Season metadata, cycles and lookback resolution as calendar dimensions.

Ranges over time become one row per calendar day, so large tables reach them with an equi-join
on the day. A dimension has at most one row per day between the first and last match (a date
column can hold 3.65 million days), which is what makes broadcasting it safe at any data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def season_table(games: DataFrame, expected: int | DataFrame) -> DataFrame:
    """One row per season. ``expected`` is a game count, or a (season_id, expected_games) table."""
    s = games.groupBy("season_id").agg(
        F.min("match_date").alias("first_match"),
        F.max("match_date").alias("last_match"),
        F.count_distinct("game_id").alias("n_games"),
        F.sum(F.col("played").cast("bigint")).alias("n_played"),
    )
    if isinstance(expected, DataFrame):
        s = s.join(expected, "season_id", "left")
    else:
        s = s.withColumn("expected_games", F.lit(expected).cast("bigint"))
    full = (F.col("n_games") == F.col("expected_games")) & (
        F.col("n_played") == F.col("expected_games")
    )
    return s.withColumn("complete", F.coalesce(full, F.lit(False)))


def transfer_cycles(seasons: DataFrame) -> DataFrame:
    """Cycle s: [day after the previous season's last match, day after its own). First dropped."""
    w = Window.partitionBy(F.lit(0)).orderBy("season_id")  # one row per season
    end = F.date_add("last_match", 1)
    return (
        seasons.select(
            "season_id", F.lag(end).over(w).alias("cycle_start"), end.alias("cycle_end_exclusive")
        )
        .where(F.col("cycle_start").isNotNull() & F.col("cycle_end_exclusive").isNotNull())
    )


def cycle_calendar(cycles: DataFrame) -> DataFrame:
    """(day, cycle): every day of every half-open cycle; on overlap the later season wins."""
    last = F.date_sub("cycle_end_exclusive", 1)
    return (
        cycles.where(F.col("cycle_start") <= last)
        .select("season_id", F.explode(F.sequence("cycle_start", last)).alias("day"))
        .groupBy("day")
        .agg(F.max("season_id").alias("cycle"))
    )


def with_cycle(df: DataFrame, on: str, cycles: DataFrame, out: str) -> DataFrame:
    cal = cycle_calendar(cycles).select(F.col("day").alias("_day"), F.col("cycle").alias(out))
    return df.join(F.broadcast(cal), df[on] == cal["_day"], "left").drop("_day")


def lookback_calendar(seasons: DataFrame, allowed: Sequence[int] | None = None) -> DataFrame:
    """For each cutoff day D: the two highest complete seasons whose last match is before D, the
    lowest season under way (first < D <= last), and whether two were found.

    Covers D from the day after the first match to the day after the last match of all; the
    state does not change later, so ``attach_lookback`` clamps D to that range.
    """
    s = seasons.where(F.col("season_id").isin(*allowed)) if allowed is not None else seasons
    horizon = F.date_add(F.max("last_match").over(Window.partitionBy(F.lit(0))), 1)
    s = s.withColumn("_horizon", horizon)
    done = s.where("complete").select(
        F.explode(F.sequence(F.date_add("last_match", 1), "_horizon")).alias("cutoff"),
        F.col("season_id").alias("_done"),
        F.lit(None).cast("int").alias("_open"),
    )
    under_way = s.where("first_match < last_match").select(
        F.explode(F.sequence(F.date_add("first_match", 1), "last_match")).alias("cutoff"),
        F.lit(None).cast("int").alias("_done"),
        F.col("season_id").alias("_open"),
    )
    two = F.slice(F.sort_array(F.collect_list("_done"), asc=False), 1, 2)
    return (
        done.unionByName(under_way)
        .groupBy("cutoff")
        .agg(two.alias("_two"), F.min("_open").alias("ongoing"))
        .select(
            "cutoff",
            F.try_element_at("_two", F.lit(1)).alias("completed_1"),
            F.try_element_at("_two", F.lit(2)).alias("completed_2"),
            "ongoing",
            (F.size("_two") == 2).alias("coverage_ok"),
        )
    )


def attach_lookback(
    df: DataFrame, on: str, seasons: DataFrame, allowed: Sequence[int] | None = None
) -> DataFrame:
    """Add completed_1, completed_2, ongoing, coverage_ok for the row's cutoff day."""
    cal = lookback_calendar(seasons, allowed)
    scope = seasons.where(F.col("season_id").isin(*allowed)) if allowed is not None else seasons
    horizon = scope.agg(F.date_add(F.max("last_match"), 1)).scalar()
    key = F.least(F.col(on), horizon)
    keyed = df.withColumn("_cutoff", F.when(F.col(on).isNotNull(), key))
    return (
        keyed.join(F.broadcast(cal), keyed["_cutoff"] == cal["cutoff"], "left")
        .drop("_cutoff", "cutoff")
        .withColumn("coverage_ok", F.coalesce("coverage_ok", F.lit(False)))
    )


def study_window(seasons: DataFrame, study_ids: Sequence[int]) -> DataFrame:
    """(name, value) dates: window start, window end, test start, from the study cycles."""
    c = transfer_cycles(seasons).where(F.col("season_id").isin(*study_ids))
    w = Window.partitionBy(F.lit(0))
    ranked = c.select(
        "*",
        F.row_number().over(w.orderBy("season_id")).alias("_up"),
        F.row_number().over(w.orderBy(F.desc("season_id"))).alias("_down"),
    )
    picked = ranked.agg(
        F.max(F.when(F.col("_up") == 1, F.col("cycle_start"))).alias("transfer_start"),
        F.max(F.when(F.col("_down") == 1, F.col("cycle_end_exclusive"))).alias(
            "transfer_end_exclusive"
        ),
        F.max(F.when(F.col("_down") == 2, F.col("cycle_start"))).alias("test_start"),
    )
    cells = [
        F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
        for n in ("transfer_start", "transfer_end_exclusive", "test_start")
    ]
    return picked.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
