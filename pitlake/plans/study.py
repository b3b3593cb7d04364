"""The composed study: labels -> features -> cycle -> partition, then exposure, price level and
context. Each step is lazy; only the assembled feature table is landed, because many passes
(medians, fits, resampling) read it again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake import bindings as B
from pitlake.functions.landing import discard, is_landed, land
from pitlake.operators import asof as A
from pitlake.operators import labels as L
from pitlake.operators import learn as M
from pitlake.operators import seasons as T
from pitlake.operators import split as P


@dataclass
class Inputs:
    """Canonical tables and derived dates of one study."""

    moves: DataFrame
    games: DataFrame
    appearances: DataFrame
    lineups: DataFrame
    players: DataFrame
    seasons: DataFrame
    expected: DataFrame
    start: Column
    end: Column
    test_start: Column


def bound_inputs(t: B.Tables, names: bool = True) -> Inputs:
    """Inputs over the star-schema tables. Season metadata is landed: a few rows, read often. Without ``names``, moves have
    no club names."""
    games = B.league_games(t)
    seasons = land(T.season_table(games, B.expected_games(games)), "seasons")
    expected = seasons.select("season_id", "expected_games")
    window = T.study_window(seasons, B.STUDY_SEASONS)
    dates = {r["name"]: r["value"] for r in window.collect()}  # three rows

    def day(name: str) -> Column:
        return F.lit(dates[name]).cast("date")

    return Inputs(
        B.moves(t, names=names), games, B.appearances(t), B.clean_lineup_rows(t).where(B.of_study_league()), B.players(t), seasons,
        expected, day("transfer_start"), day("transfer_end_exclusive"), day("test_start"),
    )


def candidates(i: Inputs, labeled: DataFrame | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Every label row with features or the first reason it has none. ``labeled`` are landed label rows, ``daily`` landed
    totals of the history."""
    # Read twice (cutoffs, join back): landing it saves a second deduplication of the moves.
    if labeled is None:
        labeled = land(L.labels(L.with_label_reason(i.moves, i.start, i.end)), "labels")
    return A.feature_candidates(
        labeled, i.appearances, i.lineups, i.players, i.seasons, B.SOURCE_SEASONS, B.MIN_MINUTES, daily=daily
    )


def assemble(i: Inputs, labeled: DataFrame | None = None, daily: DataFrame | None = None) -> DataFrame:
    """The feature table: usable candidates with cycle and partition."""
    feats = A.usable_features(candidates(i, labeled, daily))
    feats = T.with_cycle(feats, "transfer_date", T.transfer_cycles(i.seasons), "transfer_cycle")
    return P.with_partition(feats, "transfer_date", i.test_start)


#: Columns that models read, and those that further inputs are made from.
MODEL_COLUMNS = ("fee_log1p", "transfer_cycle", "partition", "position", *M.NUMERIC)
MOVE_COLUMNS = ("player_id", "transfer_date", "fee_eur", "fee_class")
KEY_COLUMNS = ("player_id", "transfer_date", "completed_1", "completed_2", "ongoing", "coverage_ok")


def landed_labels(i: Inputs, *more: str) -> DataFrame:
    """Label rows with their player, day and further columns. Moves are landed first: their filters would otherwise be taken
    below the step that collapses copies, where each of them parses dates and fees again."""
    moves = i.moves if is_landed(i.moves) else land(i.moves, "moves")
    labeled = land(L.labels(L.with_label_reason(moves, i.start, i.end)).select("player_id", "transfer_date", *more), "labels")
    if moves is not i.moves:
        discard(moves)
    return labeled


def model_features(i: Inputs, more: dict[str, Column] | None = None, keep: tuple = ()) -> DataFrame:
    """The feature table with the columns that models read, landed step by step, so that no step keeps the shuffles and the
    tables of those before it on disk. ``more`` are further sums over the lookback, ``keep`` further columns."""
    labeled = landed_labels(i, "fee_log1p")
    history = A.enrich_history(i.appearances.drop("yellow_cards", "red_cards"), i.lineups)
    daily = land(A.history_totals(history, more), "daily")
    feats = land(assemble(i, labeled, daily).select(*MODEL_COLUMNS, *keep), "features")
    discard(labeled, daily)
    return feats


def enrich(feats: DataFrame, i: Inputs, t: B.Tables, everything: DataFrame) -> DataFrame:
    """Exposure, trend, price level, context inputs on top of the feature table, which has the team points."""
    out = A.exposure_columns(feats, i.games, i.appearances, i.expected)
    out = out.withColumn("cycle_trend", A.cycle_trend())
    level = landed_price_level(feats, i, 1)
    out = out.join(F.broadcast(level), "transfer_date", "left")  # one row per cutoff day
    comps = B.competitions(t)
    others = A.other_leagues(comps, comps.where("in_study").select("competition_id"))
    europe = [n for n in range(25) if n % 5 == 3]  # nations of the international region
    out = A.context_columns(out, i.seasons, None, everything, others, europe)
    return M.with_one_hot(out, "position")


def qualifying_moves(i: Inputs) -> DataFrame:
    """Paid moves where either club played in the league in the move's cycle."""
    paid = T.with_cycle(
        i.moves.where("fee_eur > 0 and transfer_date is not null"),
        "transfer_date",
        T.transfer_cycles(i.seasons),
        "cycle",
    ).where("cycle is not null")
    return A.active_moves(paid, i.appearances, "cycle", ("from_club_id", "to_club_id"))


def landed_price_level(feats: DataFrame, i: Inputs, min_events: int) -> DataFrame:
    """Price level per cutoff day. The moves are read twice, so they are landed with two columns."""
    moves = land(qualifying_moves(i).select("transfer_date", "fee_eur"), "qualifying")
    level = A.price_level(
        feats, "transfer_date", moves, "transfer_date", "fee_eur", B.PRICE_WINDOW_DAYS, min_events
    )
    return land(level, "level")


_kept: dict | None = None


def keep_landed() -> None:
    """From now on, the landed study tables of a folder are used again within this process."""
    global _kept
    _kept = {}


def _once(build):
    def run(t: B.Tables) -> tuple[DataFrame, Inputs]:
        key = (build.__name__, t.spark.sparkContext.applicationId, t.folder)
        if _kept is None:
            return build(t)
        if key not in _kept:
            _kept[key] = build(t)
        return _kept[key]

    return run


@_once
def landed_features(t: B.Tables) -> tuple[DataFrame, Inputs]:
    i = bound_inputs(t)
    return land(assemble(i), "features"), i


@_once
def landed_model(t: B.Tables) -> DataFrame:
    """Features with the columns that models read."""
    i = bound_inputs(t, names=False)
    return model_features(replace(i, moves=i.moves.select(*MOVE_COLUMNS)))


@_once
def landed_enriched(t: B.Tables) -> DataFrame:
    """Model columns with exposure, price level and context. Appearances and moves are read by several of these steps, so
    they are landed once: the only join of lines with orders, the only deduplication. What is landed on the way goes
    when the step that reads it is done."""
    i = bound_inputs(t, names=False)
    every = land(B.appearance_rows(t, B.all_games(t), points=True).drop("yellow_cards", "red_cards", "ship_date", "l_linenumber"), "appearances")
    moves = land(i.moves.select(*MOVE_COLUMNS, "from_club_id", "to_club_id"), "moves")
    i = replace(i, appearances=every.where(B.in_study_league()), moves=moves)
    feats = model_features(i, A.points_sums(), (*KEY_COLUMNS, A.mean_points(F.col("_pts"), F.col("_m"))))
    inputs = sorted({c for cols in M.context_variants(M.variants()).values() for c in cols})
    out = land(enrich(feats, i, t, every).select("fee_log1p", "transfer_cycle", "partition", *inputs, *M.one_hot("position")), "enriched")
    discard(every, moves, feats)
    return out
