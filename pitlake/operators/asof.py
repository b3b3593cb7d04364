"""As-of joins and aggregates: only history strictly before each row's cutoff day counts.

History is first summed to one row per (entity, ..., day), and cutoffs to one row per (entity,
..., cutoff day). Both steps combine map-side, so an entity holding a third of all rows shrinks
to at most one row per calendar day before anything is grouped on it. A running range-frame
window then gives every cutoff the totals before it in one linear pass: history rows are never
paired with candidate rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.functions.ranks import STEPS, value_bucket
from pitlake.functions.scalar import POSITIONS, floor_age, is_finite, match_points, per_90
from pitlake.operators import seasons as T

STAT_SUMS = ("goals", "assists", "minutes", "yellow_cards", "red_cards")

# Reasons a candidate has no feature row, in test order.
FEATURE_REASONS = (
    "no_lookback_coverage",
    "no_league_appearances_in_lookback",
    "insufficient_lookback_minutes",
    "invalid_per90",
    "missing_age",
    "missing_position",
)

#: Parts that histogram cells are dealt into before they are copied into windows.
HISTOGRAM_PARTS = 96


def daily_totals(
    history: DataFrame,
    keys: Sequence[str],
    day: str,
    sums: Mapping[str, Column],
    distinct: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, day). A distinct count adds up over days when each counted id (a game)
    belongs to one day."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    aggs += [F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()]
    return history.groupBy(*keys, F.col(day).alias("_day")).agg(*aggs)


def totals_before(
    cutoffs: DataFrame, on: str, daily: DataFrame, keys: Sequence[str], totals: Sequence[str]
) -> DataFrame:
    """Per distinct (keys, cutoff): running totals, first and last history day before the cutoff.

    Cutoffs without earlier history are dropped.
    """
    types = dict(daily.dtypes)
    marks = cutoffs.select(*keys, F.col(on).alias("_day")).distinct()
    both = daily.select(*keys, "_day", *totals, F.lit(False).alias("_is_cut")).unionByName(
        marks.select(
            *keys,
            "_day",
            *(F.lit(None).cast(types[t]).alias(t) for t in totals),
            F.lit(True).alias("_is_cut"),
        )
    )
    both = both.withColumn("_n", F.unix_date("_day"))
    past = (
        Window.partitionBy(*keys).orderBy("_n").rangeBetween(Window.unboundedPreceding, -1)
    )
    event_day = F.when(~F.col("_is_cut"), F.col("_day"))
    return (
        both.select(
            *keys,
            F.col("_day").alias(on),
            "_is_cut",
            *(F.sum(t).over(past).alias(t) for t in totals),
            F.min(event_day).over(past).alias("first_day"),
            F.max(event_day).over(past).alias("last_day"),
        )
        .where("_is_cut and last_day is not null")
        .drop("_is_cut")
    )


def lookback_seasons(candidates: DataFrame, entity: str, on: str) -> DataFrame:
    """Distinct (entity, cutoff, season) for each covered candidate's lookback seasons."""
    ids = F.array_distinct(F.array_compact(F.array("completed_1", "completed_2", "ongoing")))
    return (
        candidates.where("coverage_ok")
        .select(entity, on, F.explode(ids).alias("season_id"))
        .distinct()
    )


def lookback_totals(
    candidates: DataFrame,
    history: DataFrame,
    entity: str,
    on: str,
    sums: Mapping[str, Column],
    distinct: Mapping[str, Column] | None = None,
    season: str = "season_id",
    day: str = "match_date",
) -> DataFrame:
    """Per (entity, cutoff, lookback season): totals over that season's rows dated before the
    cutoff. A row tagged with a lookback season but dated on or after the cutoff never counts."""
    daily = daily_totals(history, [entity, season], day, sums, distinct)
    cuts = lookback_seasons(candidates, entity, on).withColumnRenamed("season_id", season)
    return totals_before(cuts, on, daily, [entity, season], [*sums, *(distinct or {})])


def merge_seasons(
    per_season: DataFrame, entity: str, on: str, totals: Sequence[str], season: str = "season_id"
) -> DataFrame:
    """Fold the per-season totals into one row per (entity, cutoff)."""
    ids = F.array_join(F.sort_array(F.collect_set(season)).cast("array<string>"), ",")
    return per_season.groupBy(entity, on).agg(
        *(F.sum(t).alias(t) for t in totals),
        F.min("first_day").alias("first_match_date"),
        F.max("last_day").alias("last_match_date"),
        ids.alias("lookback_season_ids"),
    )


def position_counts(position: str, order: Sequence[str] = POSITIONS) -> dict[str, Column]:
    return {f"n_{p}": F.when(F.col(position) == p, 1).otherwise(0) for p in order}


def mode_of_counts(order: Sequence[str] = POSITIONS) -> Column:
    """Most frequent category from its n_ columns; ties go to the earlier one in ``order``."""
    top = F.greatest(*(F.col(f"n_{p}") for p in order))
    pick = F.lit(None).cast("string")
    for p in reversed(order):
        pick = F.when((top > 0) & (F.col(f"n_{p}") == top), F.lit(p)).otherwise(pick)
    return pick


def join_back(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of as-of results (unique per keys) onto the original rows."""
    return rows.join(found, list(keys), "left")


def enrich_history(appearances: DataFrame, lineups: DataFrame) -> DataFrame:
    cols = ["game_id", "player_id"]
    return appearances.join(lineups.select(*cols, "lineup_position"), cols, "left")


def history_totals(history: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Daily totals per player and season that features are made of, and of any further sums."""
    sums = {c: F.col(c) for c in STAT_SUMS if c in history.columns}
    sums["appearances"] = F.when(F.col("minutes") > 0, 1).otherwise(0)
    sums["lineup_position_rows"] = F.when(F.col("lineup_position").isNotNull(), 1).otherwise(0)
    sums |= position_counts("lineup_position") | dict(more or {})
    return daily_totals(history, ["player_id", "season_id"], "match_date", sums, {"lookback_match_count": F.col("game_id")})


def historical_or_proxy(df: DataFrame, historical: str, proxy: str) -> DataFrame:
    """position, its source, and a flag when the current profile stands in for history."""
    old, now = F.col(historical), F.col(proxy)
    return df.withColumns(
        {
            "position_source": F.when(old.isNotNull(), "historical_appearance").when(
                now.isNotNull(), "current_proxy"
            ),
            "position": F.coalesce(old, now),
            "position_is_proxy": old.isNull() & now.isNotNull(),
        }
    )


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first check that holds, in order; an unknown (null) check counts as failing."""
    return F.coalesce(
        *(F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in checks)
    )


def feature_candidates(
    candidates: DataFrame,
    appearances: DataFrame,
    lineups: DataFrame,
    players: DataFrame,
    seasons: DataFrame,
    allowed: Sequence[int] | None,
    min_minutes: float,
    on: str = "transfer_date",
    daily: DataFrame | None = None,
) -> DataFrame:
    """Every candidate with its as-of features and, if unusable, the first failing reason.

    ``daily`` are the ``history_totals`` where they are landed already; appearances and lineups are not read then.
    """
    entity = "player_id"
    cand = T.attach_lookback(candidates, on, seasons, allowed)
    if daily is None:
        daily = history_totals(enrich_history(appearances, lineups))
    totals = [c for c in daily.columns if c not in (entity, "season_id", "_day")]
    per_season = totals_before(lookback_seasons(cand, entity, on), on, daily, [entity, "season_id"], totals)
    found = merge_seasons(per_season, entity, on, totals)
    found = found.withColumn("_mode", mode_of_counts()).drop(*(f"n_{p}" for p in POSITIONS))
    df = join_back(cand, found, [entity, on])
    profile = players.select(entity, "name", "date_of_birth", "current_position")
    df = df.join(profile, entity, "left")
    df = historical_or_proxy(df, "_mode", "current_position").drop("_mode")
    df = df.withColumns(
        {
            "goals_per90": per_90("goals", "minutes", min_minutes),
            "assists_per90": per_90("assists", "minutes", min_minutes),
            "age": floor_age("date_of_birth", on),
        }
    )
    enough = F.col("minutes") >= min_minutes
    failing = (
        ~F.col("coverage_ok"),
        F.col("lookback_match_count").isNull(),
        ~enough,
        F.col("goals_per90").isNull() | F.col("assists_per90").isNull(),
        F.col("age").isNull(),
        F.col("position").isNull(),
    )
    reason = first_reason(list(zip(FEATURE_REASONS, failing, strict=True)))
    return df.withColumn("feature_exclusion_reason", reason)


def usable_features(candidates: DataFrame) -> DataFrame:
    return candidates.where("feature_exclusion_reason is null")


def asof_latest_by_day(
    rows: DataFrame,
    values: DataFrame,
    entity: str,
    on: str,
    day: str,
    value: str,
    max_days: int,
) -> DataFrame:
    """Latest value strictly before each row's day. Too old keeps date and age, drops the value.

    Several values on one day: the largest counts.
    """
    daily = values.groupBy(entity, F.col(day).alias("_day")).agg(F.max(value).alias("_v"))
    marks = rows.select(entity, F.col(on).alias("_day")).distinct()
    both = daily.select(entity, "_day", F.struct("_day", "_v").alias("_last")).unionByName(
        marks.withColumn("_last", F.lit(None).cast("struct<_day:date,_v:double>"))
    )
    past = (
        Window.partitionBy(entity)
        .orderBy(F.unix_date("_day"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    found = (
        both.withColumn("_prior", F.max("_last").over(past))
        .where("_last is null and _prior is not null")
        .select(entity, F.col("_day").alias(on), "_prior")
    )
    age = F.datediff(F.col(on), F.col("_prior._day"))
    status = (
        F.when(F.col("_prior").isNull(), "no_prior_valuation")
        .when(age > max_days, "stale")
        .otherwise("matched")
    )
    out = rows.join(found, [entity, on], "left")
    return (
        out.withColumn("valuation_date", F.col("_prior._day"))
        .withColumn("valuation_age_days", age)
        .withColumn("market_value_status", status)
        .withColumn("market_value_eur", F.when(age <= max_days, F.col("_prior._v")))
        .drop("_prior")
    )


def asof_latest_by_time(
    rows: DataFrame,
    values: DataFrame,
    entity: str,
    at: str,
    value: str,
    slot_seconds: int = 3600,
) -> DataFrame:
    """Latest (time, value) strictly before each row's timestamp, for fine-grained event times.

    A row looks inside its own (entity, time slot); slots then hand their last value forward.
    A hot entity is split over its slots, and only one row per slot reaches the per-entity pass.
    """

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    width = slot_seconds * 1_000_000
    left = rows.withColumn("_t", micros(at)).withColumn("_slot", F.floor(F.col("_t") / width))
    right = values.select(
        entity,
        micros(at).alias("_t"),
        F.floor(micros(at) / width).alias("_slot"),
        F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("_event"),
    )
    # Several events at one instant collapse to the largest value before the shuffle.
    right = right.groupBy(entity, "_slot", "_t").agg(F.max("_event").alias("_event"))
    payload = right.schema["_event"].dataType.simpleString()
    marks = left.select(entity, "_slot", "_t").distinct()
    null_event = F.lit(None).cast(payload)
    own = Window.partitionBy(entity, "_slot").orderBy("_t").rangeBetween(
        Window.unboundedPreceding, -1
    )
    in_slot = (
        right.select(entity, "_slot", "_t", "_event", F.lit(False).alias("_mark"))
        .unionByName(marks.withColumn("_event", null_event).withColumn("_mark", F.lit(True)))
        .withColumn("_found", F.max("_event").over(own))
        .where("_mark")
        .select(entity, "_slot", "_t", "_found")
    )
    slots = right.groupBy(entity, "_slot").agg(F.max("_event").alias("_event"))
    earlier = Window.partitionBy(entity).orderBy("_slot").rangeBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        slots.withColumn("_mark", F.lit(False))
        .unionByName(
            marks.select(entity, "_slot")
            .distinct()
            .withColumn("_event", null_event)
            .withColumn("_mark", F.lit(True))
        )
        .withColumn("_carried", F.max("_event").over(earlier))
        .where("_mark")
        .select(entity, "_slot", "_carried")
    )
    prior = in_slot.join(carried, [entity, "_slot"], "left").select(
        entity, "_t", F.coalesce("_found", "_carried").alias("_prior")
    )
    return (
        left.join(prior, [entity, "_t"], "left")
        .withColumn("prior_at", F.col("_prior.at"))
        .withColumn("prior_value", F.col("_prior.value"))
        .drop("_t", "_slot", "_prior")
    )


def active_moves(
    moves: DataFrame, active: DataFrame, cycle: str = "cycle", clubs: Sequence[str] = ()
) -> DataFrame:
    """Moves where either club is active in the move's cycle; ``active`` is (season_id, club_id).

    One left join per club column against unique pairs, then an OR over flags: no OR-join.
    """
    out = moves
    pairs = active.select("season_id", "club_id").distinct()
    flags = []
    for i, club in enumerate(clubs):
        side = pairs.select(
            F.col("season_id").alias(f"_s{i}"), F.col("club_id").alias(f"_c{i}")
        ).withColumn(f"_hit{i}", F.lit(True))
        out = out.join(
            side, (out[cycle] == side[f"_s{i}"]) & (out[club] == side[f"_c{i}"]), "left"
        ).drop(f"_s{i}", f"_c{i}")
        flags.append(F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    keep = flags[0]
    for f in flags[1:]:
        keep = keep | f
    return out.where(keep).drop(*(f"_hit{i}" for i in range(len(clubs))))


def _counts_in_windows(per_day: DataFrame, want: DataFrame, on: str, window: int, by: Sequence[str] = ()) -> DataFrame:
    """(cutoff, by, bucket, count) over [cutoff - window, cutoff) from (day, by, bucket, count) rows.

    Only the (cutoff, by) pairs of ``want`` are counted; it holds a few rows per cutoff.

    Cutoffs are grouped in blocks of about sqrt(window / 2) days. Days inside every window of a
    block are counted once per block; only the days at the block's two edges are counted per
    cutoff. A day is thus copied about 2 sqrt(window) times instead of ``window`` times.

    Cells are few bytes, and a task copies them many times: they are dealt into a fixed number of parts, which
    is not coalesced into one task, both before a day and before a block is copied.
    """
    per_day = per_day.repartition(HISTOGRAM_PARTS, "_day", *by, "_b")
    size = max(1, int((window / 2) ** 0.5))
    day = F.col("_day")

    def block(x: Column) -> Column:
        return F.floor(x / size)

    def spread(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
        ranged = rows.withColumn("_first", first).withColumn("_last", last)
        return ranged.where("_first <= _last").select(
            F.explode(F.sequence("_first", "_last")).alias(name), *by, "_b", "_c"
        )

    want = want.select(on, *by)
    shared = spread(per_day, block(day) + 1, block(day + window + 1 - size), "_block")
    shared = shared.groupBy("_block", *by, "_b").agg(F.sum("_c").alias("_c")).repartition(HISTOGRAM_PARTS, "_block", *by, "_b")
    blocks = F.broadcast(want.withColumn("_block", block(F.col(on))))
    whole = shared.join(blocks, ["_block", *by]).select(on, *by, "_b", "_c")
    late = spread(per_day, day + 1, (block(day) + 1) * size - 1, on)
    leaving = per_day.where(F.pmod(day + window + 1, F.lit(size)) != 0)
    early = spread(leaving, block(day + window) * size, day + window, on)
    edges = late.unionByName(early).join(F.broadcast(want), [on, *by])
    return whole.unionByName(edges).groupBy(on, *by, "_b").agg(F.sum("_c").alias("_c"))


def _holding(counts: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """Cells that hold one of the ranks _lo and _hi, with the rank before each as _from.

    ``counts`` has (cutoff, by, _b, _c) and the ranks, with _start values before the (cutoff, by) group.
    """
    upto = Window.partitionBy(on, *by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.withColumn("_to", F.col("_start") + F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    return cells.where(" or ".join(f"({r} >= _from and {r} < _to)" for r in ("_lo", "_hi")))


def trailing_median(
    cutoffs: DataFrame,
    on: str,
    events: DataFrame,
    day: str,
    value: str,
    window_days: int,
    per_e_fold: int = 64,
) -> DataFrame:
    """Exact median and count of event values in [D - window_days, D) per distinct cutoff D.

    Three histograms, each counted per day first and then over the windows by the same blocks of days: of
    value buckets, of even steps between the least and largest value of the bucket that holds a median,
    of the values of the step that holds it. A day's cells are copied about 2 sqrt(window_days) times, no
    value once per cutoff, and what is walked in order is one step's distinct values.
    """
    ev = events.select(
        F.unix_date(F.col(day)).cast("bigint").alias("_day"), F.col(value).cast("double").alias("_v")
    ).where("_day is not null and _v is not null")
    ev = ev.withColumn("_b0", value_bucket(F.col("_v"), per_e_fold))
    want = (  # at most one row per day
        cutoffs.select(F.unix_date(on).cast("bigint").alias(on)).distinct().where(F.col(on).isNotNull())
    )
    ranks = ["_n", "_lo", "_hi"]

    def counted(rows: DataFrame, want: DataFrame, by: Sequence[str], cell: str) -> DataFrame:
        per_day = rows.groupBy("_day", *by, F.col(cell).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        return _counts_in_windows(per_day, want, on, window_days, by)

    def narrowed(rows: DataFrame, chosen: DataFrame, by: Sequence[str], cell: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of the chosen cells, what is wanted of them per cutoff, and their window counts by `cell`."""
        wanted = land(chosen.select(on, *by[:-1], F.col("_b").alias(by[-1]), F.col("_from").alias("_start"), *ranks), "wanted")
        rows = rows.join(F.broadcast(wanted.select(*by).distinct()), list(by))  # at most two cells per day
        return rows, wanted, counted(rows, wanted, by, cell).join(F.broadcast(wanted), [on, *by])

    total = F.sum("_c").over(Window.partitionBy(on))
    counts = counted(ev, want, [], "_b0").withColumn("_n", total).withColumn("_start", F.lit(0).cast("bigint"))
    counts = counts.withColumn("_lo", F.floor((F.col("_n") - 1) / 2)).withColumn("_hi", F.ceil((F.col("_n") - 1) / 2))
    spans = ev.groupBy("_b0").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))  # one row per bucket
    share = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS)
    # A double has some 100,000 buckets at most. Joined by a shuffle, all values of a bucket would meet in one task.
    stepped = ev.join(F.broadcast(spans), "_b0").withColumn("_b1", F.when(F.col("_high") > F.col("_low"), share).otherwise(0))
    rows, _, counts = narrowed(stepped, _holding(counts, on, []), ["_b0"], "_b1")
    _, _, counts = narrowed(rows, _holding(counts, on, ["_b0"]), ["_b0", "_b1"], "_v")
    cells = _holding(counts, on, ["_b0", "_b1"])
    lo, hi = (F.max(F.expr(f"case when {r} >= _from and {r} < _to then _b end")) for r in ("_lo", "_hi"))
    out = cells.groupBy(on).agg(
        ((lo + hi) / 2).alias("median_value"), F.max("_n").alias("n_events")
    )
    return out.withColumn(on, F.date_from_unix_date(F.col(on).cast("int")))


def price_level(
    cutoffs: DataFrame,
    on: str,
    moves: DataFrame,
    day: str,
    value: str,
    window_days: int,
    min_events: int,
) -> DataFrame:
    """Log of the trailing median per distinct cutoff, with a flag below the required count."""
    med = trailing_median(cutoffs, on, moves, day, value, window_days)
    want = cutoffs.select(on).distinct().where(F.col(on).isNotNull())
    n = F.coalesce(F.col("n_events"), F.lit(0)).cast("bigint")
    return want.join(med, on, "left").select(
        on,
        F.ln("median_value").alias("league_price_level"),
        n.alias("price_level_transfers"),
        (n < min_events).alias("below_minimum"),
    )


def window_sums(
    rows: DataFrame,
    history: DataFrame,
    entity: str,
    start: str,
    on: str,
    day: str,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Rows plus sums over history in [start, on), 0 where there is none.

    Without both ends of the window, or with start after on, the sums are null.

    Running totals at both ends of the window are subtracted, so any window length costs the same. Both ends are looked up in
    one pass over the history, once per distinct window, and rows are joined once.
    """
    daily = daily_totals(history, [entity], day, sums)
    types = dict(daily.dtypes)
    windows = rows.select(entity, start, on).where(F.col(start) <= F.col(on)).distinct()
    ends = F.explode(F.array(F.struct(F.col(start).alias("_day"), F.lit(-1).alias("_end")), F.struct(F.col(on).alias("_day"), F.lit(1).alias("_end"))))
    marks = windows.select(entity, start, on, ends.alias("_e")).select(entity, start, on, "_e.*", *(F.lit(None).cast(types[s]).alias(s) for s in sums))
    past = Window.partitionBy(entity).orderBy("_n").rangeBetween(Window.unboundedPreceding, -1)
    run = (
        daily.unionByName(marks, allowMissingColumns=True)
        .withColumn("_n", F.unix_date("_day"))
        .select(entity, start, on, "_end", *(F.sum(s).over(past).alias(s) for s in sums))
        .where("_end is not null")
    )
    zero = F.lit(0.0)

    def at(s: str, end: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_end") == end, F.col(s))), zero)

    found = run.groupBy(entity, start, on).agg(*((at(s, 1) - at(s, -1)).alias(s) for s in sums))
    out = rows.join(found, [entity, start, on], "left")
    return out.withColumns({s: F.when(F.col(start) <= F.col(on), F.coalesce(F.col(s), zero)) for s in sums})


def with_points(appearances: DataFrame, games: DataFrame) -> DataFrame:
    """Appearances with the points their club took in the game (null if unplayed)."""
    g = games.select(
        "game_id", "home_club_id", "away_club_id", "home_club_goals", "away_club_goals"
    )
    pts = match_points(
        F.col("club_id"),
        F.col("home_club_id"),
        F.col("away_club_id"),
        F.col("home_club_goals"),
        F.col("away_club_goals"),
    )
    joined = appearances.join(g.withColumn("_found", F.lit(True)), "game_id", "left")
    return joined.withColumn("points", F.when(F.col("_found"), pts)).drop(
        "home_club_id", "away_club_id", "home_club_goals", "away_club_goals", "_found"
    )


def points_sums() -> dict[str, Column]:
    """Points of matches with minutes, and how many such matches have points."""
    points = F.when(F.col("minutes") > 0, F.col("points"))
    return {"_pts": points, "_m": F.when(points.isNotNull(), 1).otherwise(0)}


def mean_points(points: Column, matches: Column) -> Column:
    return F.try_divide(points, matches.cast("double")).alias("team_points_per_game")


def team_points(rows: DataFrame, points: DataFrame, entity: str, on: str) -> DataFrame:
    """Rows plus mean points over lookback matches with minutes, before the cutoff."""
    per = lookback_totals(rows, points.where("minutes > 0"), entity, on, points_sums())
    mean = per.groupBy(entity, on).agg(mean_points(F.sum("_pts"), F.sum("_m")))
    return rows.join(mean, [entity, on], "left")


def with_window_start(rows: DataFrame, seasons: DataFrame) -> DataFrame:
    """First match of the earlier completed lookback season. One row per season is broadcast."""
    first = seasons.select(
        F.col("season_id").alias("completed_2"), F.col("first_match").alias("lookback_window_start")
    )
    return rows.join(F.broadcast(first), "completed_2", "left")


def other_leagues(competitions: DataFrame, study_ids: DataFrame) -> DataFrame:
    """Domestic leagues outside the study league."""
    return (
        competitions.where("type = 'domestic_league'")
        .select("competition_id")
        .join(study_ids, "competition_id", "left_anti")
    )


def context_columns(
    rows: DataFrame,
    seasons: DataFrame,
    league_points: DataFrame | None,
    all_appearances: DataFrame,
    others: DataFrame,
    europe_ids: Sequence,
    entity: str = "player_id",
    on: str = "transfer_date",
) -> DataFrame:
    """europe minutes, other-league minutes and goals in [first match of completed_2, D), and mean
    team points over the lookback. Zero where the player has no such rows. Without ``league_points`` (rows that have
    their team points) the last is left out."""
    flag = others.select("competition_id").distinct().withColumn("_other", F.lit(True))
    tagged = all_appearances.join(flag, "competition_id", "left")
    europe = F.col("competition_id").isin(*europe_ids)
    sums = {
        "europe_minutes": F.when(europe, F.col("minutes").cast("double")).otherwise(0.0),
        "other_league_minutes": F.when(F.col("_other"), F.col("minutes").cast("double")).otherwise(
            0.0
        ),
        "other_league_goals": F.when(F.col("_other"), F.col("goals").cast("double")).otherwise(0.0),
    }
    out = with_window_start(rows, seasons)
    out = window_sums(out, tagged, entity, "lookback_window_start", on, "match_date", sums)
    return out if league_points is None else team_points(out, league_points, entity, on)


def ongoing_share(
    rows: DataFrame, games: DataFrame, expected: int | DataFrame, on: str = "transfer_date"
) -> DataFrame:
    """Rows plus the share of the ongoing season's expected games dated before the cutoff.

    Counted per (season, day) and per distinct (season, cutoff): both at most one row per day.
    """
    daily = daily_totals(games, ["season_id"], "match_date", {"_g": F.lit(1)})
    cuts = rows.where("ongoing is not null").select(F.col("ongoing").alias("season_id"), on)
    before = totals_before(cuts, on, daily, ["season_id"], ["_g"])
    if isinstance(expected, DataFrame):
        before = before.join(F.broadcast(expected), "season_id", "left")
    else:
        before = before.withColumn("expected_games", F.lit(expected))
    share = before.select(
        F.col("season_id").alias("ongoing"),
        on,
        (F.col("_g") / F.col("expected_games")).alias("ongoing_season_share"),
    )
    return rows.join(F.broadcast(share), ["ongoing", on], "left").withColumn(
        "ongoing_season_share", F.coalesce("ongoing_season_share", F.lit(0.0))
    )


def team_matches(appearances: DataFrame) -> DataFrame:
    """Per season, the most distinct games any club played."""
    per_club = appearances.groupBy("season_id", "club_id").agg(
        F.count_distinct("game_id").alias("_g")
    )
    return per_club.groupBy("season_id").agg(F.max("_g").alias("team_matches"))


def exposure_columns(
    rows: DataFrame, games: DataFrame, appearances: DataFrame, expected: int | DataFrame
) -> DataFrame:
    """Lookback totals normalised by how much league play was on offer before the cutoff."""
    out = ongoing_share(rows, games, expected)
    matches = land(team_matches(appearances), "team-matches")  # one row per season, joined three times
    for i, c in enumerate(("completed_1", "completed_2", "ongoing")):
        side = matches.select(
            F.col("season_id").alias(c), F.col("team_matches").cast("double").alias(f"_m{i}")
        )
        out = out.join(F.broadcast(side), c, "left")
    m0, m1, m2 = (F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i in range(3))
    share = F.col("ongoing_season_share")
    done = F.col("completed_1").isNotNull().cast("int") + F.col("completed_2").isNotNull().cast(
        "int"
    )
    out = (
        out.withColumn("lookback_season_equivalents", done + share)
        .withColumn("available_team_matches", m0 + m1 + m2 * share)
        .drop("_m0", "_m1", "_m2")
    )
    eq, avail = F.col("lookback_season_equivalents"), F.col("available_team_matches")
    return (
        out.withColumn("goals_per_season", F.try_divide("goals", eq))
        .withColumn("assists_per_season", F.try_divide("assists", eq))
        .withColumn("minutes_share", F.try_divide("minutes", 90 * avail))
        .withColumn("appearance_share", F.try_divide("appearances", avail))
        .withColumn(
            "window", F.when(F.col("ongoing").isNotNull(), "in_season").otherwise("off_season")
        )
    )


def no_available_matches(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("available_team_matches") > 0, F.lit(False)))


def cycle_trend(cycle: str = "transfer_cycle") -> Column:
    return F.col(cycle).cast("double")


def resolve_entities(requests: DataFrame, players: DataFrame) -> DataFrame:
    """Resolve (request_id, want_id, want_name) by id, else exact name, else normalised name.

    Names are first counted per name, so the joins see unique keys and a very common name costs
    one row. Status: resolved / unknown / ambiguous, with the match kind and count.
    """
    from pitlake.functions.scalar import name_key

    ids = players.select(F.col("player_id").alias("_id")).distinct()
    exact = players.groupBy(F.col("name").alias("_en")).agg(
        F.count(F.lit(1)).alias("_ec"), F.min("player_id").alias("_eid")
    )
    norm = players.groupBy(name_key("name").alias("_nn")).agg(
        F.count(F.lit(1)).alias("_nc"), F.min("player_id").alias("_nid")
    )
    r = requests.join(ids, F.col("want_id") == F.col("_id"), "left")
    r = r.join(exact, F.col("want_name") == F.col("_en"), "left")
    r = r.join(norm, name_key("want_name") == F.col("_nn"), "left")
    by_id = F.col("want_id").isNotNull()
    kind = (
        F.when(by_id, F.when(F.col("_id").isNotNull(), "id"))
        .when(F.col("_ec").isNotNull(), "exact_name")
        .when(F.col("_nc").isNotNull(), "normalised_name")
    )
    n = F.when(kind == "id", 1).when(kind == "exact_name", F.col("_ec")).when(
        kind == "normalised_name", F.col("_nc")
    )
    hit = F.when(kind == "id", F.col("_id")).when(kind == "exact_name", F.col("_eid")).when(
        kind == "normalised_name", F.col("_nid")
    )
    n = F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint"))
    return r.select(
        "request_id",
        F.coalesce(kind, F.lit("none")).alias("match_kind"),
        n.alias("matches"),
        F.when(n == 0, "unknown").when(n > 1, "ambiguous").otherwise("resolved").alias("status"),
        F.when(n == 1, hit).alias("player_id"),
    )


def scoring_guards(on: str, last_training: Column, coverage_end: Column) -> Column:
    """Why a scoring row must be refused, null if it may be scored."""
    return F.when(F.col(on) <= last_training, "not_after_last_training_date").when(
        F.col(on) > coverage_end, "beyond_source_coverage"
    )


def finite_check(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & is_finite(F.col(c).cast("double"))
    return ok
