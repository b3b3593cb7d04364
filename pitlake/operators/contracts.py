"""Data contracts. Each returns violating rows; ``require_none`` turns them into an error."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.scalar import is_finite


class ContractError(ValueError):
    pass


def require_none(violations: DataFrame, message: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{message}: {[r.asDict() for r in rows]}")


def first_per_key(df: DataFrame, subset: Sequence[str], order: str) -> DataFrame:
    """One row per subset value, the one lowest in ``order`` (source row), plus ``copies``.

    An aggregate rather than row_number: copies collapse before the shuffle, so a group holding
    a third of all rows sends one row per map task.
    """
    rest = [c for c in df.columns if c not in subset and c != order]
    if not rest:
        return df.groupBy(*subset).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).select(*df.columns, "copies")
    first = F.min(F.struct(order, *rest)).alias("_first")
    out = df.groupBy(*subset).agg(first, F.count(F.lit(1)).alias("copies"))
    return out.select(
        *(F.col(c) if c in subset else F.col(f"_first.{c}").alias(c) for c in df.columns), "copies"
    )


def key_conflicts(df: DataFrame, key: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Keys whose remaining fields differ: (key, variants, rows)."""
    variants = df.groupBy(*key, *rest).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        variants.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("_rows").alias("rows"))
        .where("variants > 1")
    )


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that are null or repeated: (key, rows, problem)."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col(key).isNull() | (F.col("rows") > 1))
        .withColumn("problem", F.when(F.col(key).isNull(), "null_key").otherwise("duplicate_key"))
    )


def invalid_stats(columns: Sequence[str]) -> Column:
    """True when any statistic is null or negative."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) for c in columns])


def reference_mismatches(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected reference rows that are absent or differ in any compared column."""
    fields = [c for c in expected.columns if c != key]
    got = actual.select(F.col(key).alias("_key"), *(F.col(c).alias(f"actual_{c}") for c in fields))
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"actual_{c}")) for c in fields]
    )
    problem = F.when(F.col("_key").isNull(), "absent").when(~same, "differs")
    return (
        expected.join(got, expected[key] == got["_key"], "left")
        .withColumn("problem", problem)
        .where("problem is not null")
        .drop("_key")
    )


def gates(actuals: DataFrame, required: dict[str, int]) -> DataFrame:
    """One row per gate from a one-row table of counts: (gate, required, actual, passed)."""
    rows = [
        F.struct(
            F.lit(g).alias("gate"),
            F.lit(need).cast("bigint").alias("required"),
            F.col(g).cast("bigint").alias("actual"),
            (F.col(g) >= need).alias("passed"),
        )
        for g, need in required.items()
    ]
    return actuals.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def drift(derived: DataFrame, pinned: DataFrame, key: str, value: str) -> DataFrame:
    """Names whose pinned and derived values differ or exist on one side only."""
    d = derived.select(F.col(key), F.col(value).alias("derived"))
    p = pinned.select(F.col(key), F.col(value).alias("pinned"))
    return d.join(p, key, "full_outer").where(~F.col("derived").eqNullSafe(F.col("pinned")))


def non_finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, bad) where bad counts null, NaN and infinite cells. One pass."""
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count(F.when(~is_finite(F.col(c).cast("double")), 1)).alias(c) for c in columns),
    )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(c).alias("bad")
        )
        for c in columns
    ]
    return stats.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def unpivot(one_row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row aggregate as (metric, value) rows, values as double."""
    cells = [
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
        for c in one_row.columns
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def capabilities(moves: DataFrame, players: DataFrame, history: DataFrame, seasons: DataFrame) -> DataFrame:
    """(metric, value): what the cleaned tables can support, as shares, and 1 or 0 for yes or no.

    ``history`` are appearances with their lineup label. One aggregate per table; uniqueness comes from counts per
    key, combined before the exchange, so a repeated key is never gathered.
    """
    def share(part: str) -> Column:
        return F.sum(part) / F.sum("n")

    rows = F.count(F.lit(1))
    per_move = moves.groupBy("transfer_id").agg(
        rows.alias("n"), F.count("player_id").alias("p"), F.count("transfer_date").alias("d"),
        F.count(F.when(F.col("fee_class") == "paid", 1)).alias("paid"))
    per_player = players.groupBy("player_id").agg(rows.alias("n"), F.count("date_of_birth").alias("b"))
    parts = [
        per_move.agg(
            share("p").alias("moves_with_player"), share("d").alias("moves_with_date"),
            (F.sum("paid") > 0).cast("int").alias("any_paid"), (F.max("n") == 1).cast("int").alias("unique_move_keys")),
        per_player.agg((F.max("n") == 1).cast("int").alias("unique_players"), share("b").alias("birth_date_share")),
        history.agg(
            (F.count("match_date") / rows).alias("appearances_dated"), (F.count("season_id") / rows).alias("appearances_in_season"),
            rows.alias("appearance_rows"), (F.count("lineup_position") / rows).alias("lineup_share")),
        seasons.agg(F.max(F.col("complete").cast("int")).alias("any_complete_season")),
    ]
    return reduce(DataFrame.unionByName, [unpivot(p) for p in parts])


# Least values of the capabilities a study needs.
REQUIRED = {
    "moves_with_player": 1.0, "unique_players": 1.0, "moves_with_date": 0.99, "any_paid": 1.0, "appearances_dated": 1.0,
    "appearances_in_season": 1.0, "appearance_rows": 1.0, "unique_move_keys": 1.0, "any_complete_season": 1.0, "birth_date_share": 0.95,
}


def missing_capabilities(found: DataFrame) -> DataFrame:
    """(metric, value) of required capabilities that are not met; dates and births must exceed their share."""
    least = F.create_map(*(F.lit(x) for kv in REQUIRED.items() for x in kv))[F.col("metric")]
    strict = F.col("metric").isin("moves_with_date", "birth_date_share")
    met = F.when(strict, F.col("value") > least).otherwise(F.col("value") >= least)
    return found.where(least.isNotNull() & ~F.coalesce(met, F.lit(False)))


def count_differences(a: DataFrame, b: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """Cross-run check: rows on one side only, and cells farther apart than their tolerance."""
    left = a.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = b.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in columns))
    left, right = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    j = left.join(right, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    off = [
        F.count(
            F.when(
                both
                & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
                & ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tol, F.lit(False)),
                1,
            )
        ).alias(f"off_{c}")
        for c, tol in columns.items()
    ]
    return j.agg(
        F.count(F.when(both, 1)).alias("matched"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_first"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_second"),
        *off,
    )


def later_rows(cutoffs: DataFrame, entity: str, at: str, day: str, row: dict[str, Column]) -> DataFrame:
    """History that no feature may see: per entity two rows, on the day of its last cutoff and on the day after.

    ``row`` gives further columns of the history; it may use the columns of ``cutoffs`` (one row per entity,
    its last cutoff and the least of every other column) and should be as loud as possible.
    """
    rest = [c for c in cutoffs.columns if c not in (entity, at)]
    last = cutoffs.where(F.col(at).isNotNull()).groupBy(entity).agg(F.max(at).alias(at), *(F.min(c).alias(c) for c in rest))
    days = F.explode(F.array(F.col(at), F.date_add(at, 1)))
    return last.withColumn(day, days).select(entity, day, *(v.alias(c) for c, v in row.items()))


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, fewer, more): keys whose rows differ between two tables, with how many rows went and came.

    Rows are compared by a hash of all columns that tells a null from any value and from a null elsewhere.
    One exchange by key and hash; equal rows cancel before it.
    """
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*key, F.xxhash64(*cells).alias("_h"), F.lit(sign).alias("_s"))

    sums = signed(before, -1).unionByName(signed(after, 1)).groupBy(*key, "_h").agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return sums.groupBy(*key).agg(F.sum(F.greatest(-F.col("_s"), F.lit(0))).alias("fewer"), F.sum(F.greatest("_s", F.lit(0))).alias("more"))


def future_leaks(
    build: Callable[[DataFrame], DataFrame], history: DataFrame, later: DataFrame, key: Sequence[str], columns: Sequence[str],
    built: DataFrame | None = None,
) -> DataFrame:
    """Keys whose features change once later rows are added to the history that ``build`` reads.

    ``build`` maps a history to a feature table and may be any composition; a builder that looks only before
    each cutoff gives no rows. ``later`` may lack columns of the history, which are then null. ``built`` is the table that
    ``build`` made of the history, where it is landed already.
    """
    return changed_rows(build(history) if built is None else built, build(history.unionByName(later, allowMissingColumns=True)), key, columns)


def leakage_audit(
    features: DataFrame, leaks: DataFrame, key: str, at: str, last_seen: str, partition: str
) -> DataFrame:
    """(check_name, violations): history on or after the cutoff, keys in several partitions, rows changed by later history."""
    sides = features.groupBy(key).agg((F.min(partition) < F.max(partition)).alias("_both"))
    checks = {
        "history_on_or_after_cutoff": features.agg(F.count(F.when(F.col(last_seen) >= F.col(at), 1)).alias("violations")),
        "keys_on_both_sides": sides.agg(F.count(F.when(F.col("_both"), 1)).alias("violations")),
        "changed_by_later_rows": leaks.agg(F.coalesce(F.sum("fewer"), F.lit(0)).alias("violations")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("check_name"), "violations") for n, df in checks.items()])
