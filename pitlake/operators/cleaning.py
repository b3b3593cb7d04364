"""Raw study tables to canonical typed tables. IDs are text, dates are dates, money is double."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions import scalar as S
from pitlake.functions.landing import land
from pitlake.operators import contracts as C

TRANSFER_KEY = ["player_id", "transfer_date", "from_club_id", "to_club_id"]
STATS = ["minutes", "goals", "assists", "yellow_cards", "red_cards"]


def type_transfers(raw: DataFrame) -> DataFrame:
    """Needs a source_row column: "first" must mean first in the source, whatever the split.

    The fee is parsed here, below the deduplication, so it is one stored column afterwards and
    later filters on its class do not parse the text again. Its trimmed text and number are columns
    of their own: the class and the amount name them a dozen times, and each would be a parse.
    """
    raw = raw.withColumn("_fee_text", S.trimmed("transfer_fee"))
    raw = raw.withColumn("_fee_number", S.to_number(F.col("_fee_text"), trim=False))
    raw = raw.withColumn("_fee_class", S.class_of_fee(F.col("_fee_text"), F.col("_fee_number")))
    return raw.select(
        "source_row",
        S.clean_id("player_id").alias("player_id"),
        S.parse_date("transfer_date").alias("transfer_date"),
        F.col("transfer_season").cast("string").alias("transfer_season"),
        S.clean_id("from_club_id").alias("from_club_id"),
        S.clean_id("to_club_id").alias("to_club_id"),
        F.col("from_club_name").cast("string").alias("from_club_name"),
        F.col("to_club_name").cast("string").alias("to_club_name"),
        F.col("transfer_fee").cast("string").alias("raw_fee"),
        F.when(F.col("_fee_class") == S.PAID, F.col("_fee_number")).alias("fee_eur"),
        F.col("_fee_class").alias("fee_class"),
    )


def with_transfer_id(typed: DataFrame) -> DataFrame:
    return typed.select(
        "*",
        S.surrogate_key("player_id", "transfer_date", "from_club_id", "to_club_id").alias(
            "transfer_id"
        ),
    )


def transfer_conflicts(typed: DataFrame) -> DataFrame:
    return C.key_conflicts(typed, TRANSFER_KEY, ["raw_fee", "transfer_season"])


def clean_transfers(raw: DataFrame, names: bool = True) -> DataFrame:
    """Typed moves with exact copies removed; ``copies`` keeps the removed count per row.

    Without the club names all that copies differ in is their source row, so they collapse by hash, not by sorting.
    """
    subset = [*TRANSFER_KEY, "raw_fee", "transfer_season"]
    typed = type_transfers(raw)
    if not names:
        subset += ["fee_eur", "fee_class"]  # read from raw_fee
        typed = typed.drop("from_club_name", "to_club_name")
    return with_transfer_id(C.first_per_key(typed, subset, "source_row"))


def dedup_stats(deduped: DataFrame) -> DataFrame:
    return deduped.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_duplicates_removed"),
    )


def clean_players(raw: DataFrame) -> DataFrame:
    return raw.select(
        S.clean_id("player_id").alias("player_id"),
        F.col("name").cast("string").alias("name"),
        S.parse_date("date_of_birth").alias("date_of_birth"),
        F.col("position").cast("string").alias("current_position_raw"),
        S.map_codes("position", S.PROFILE_GROUPS).alias("current_position"),
    )


def clean_games(raw: DataFrame, competition_ids: Sequence[str]) -> DataFrame:
    return raw.select(
        S.clean_id("game_id").alias("game_id"),
        S.clean_id("competition_id").alias("competition_id"),
        F.col("season").try_cast("int").alias("season_id"),
        S.parse_date("date").alias("match_date"),
        S.both_present("home_club_goals", "away_club_goals").alias("played"),
    ).where(F.col("competition_id").isin(*competition_ids))


def clean_appearances(
    raw: DataFrame, games: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(all deduplicated league rows with flags, the valid rows).

    Copies on (game, player, statistics) collapse first, then invalid statistics are flagged. The row
    kept is the first by ``order``: source_row where the raw table carries it, else appearance_id.
    ``appearance_conflicts`` on the first result finds what is left of a (game, player).
    """
    order = order or ("source_row" if "source_row" in raw.columns else "appearance_id")
    typed = raw.select(
        *([] if order == "appearance_id" else [order]),
        S.clean_id("appearance_id").alias("appearance_id"),
        S.clean_id("game_id").alias("game_id"),
        S.clean_id("player_id").alias("player_id"),
        S.clean_id("player_club_id").alias("club_id"),
        S.parse_date("date").alias("appearance_date"),
        S.clean_id("competition_id").alias("competition_id"),
        S.to_number("minutes_played").alias("minutes"),
        *(S.to_number(c).alias(c) for c in STATS[1:]),
    )
    league = typed.join(games.select("game_id", "season_id", "match_date"), "game_id")
    one = C.first_per_key(league, ["game_id", "player_id", *STATS], order)
    flagged = one.select(
        "*",
        C.invalid_stats(STATS).alias("invalid"),
        (~F.col("appearance_date").eqNullSafe(F.col("match_date"))).alias("date_mismatch"),
    )
    valid = flagged.where(~F.col("invalid")).drop(
        "invalid", "date_mismatch", "copies", "appearance_date"
    )
    return flagged, valid


def appearance_conflicts(flagged: DataFrame) -> DataFrame:
    """(game, player) pairs whose deduplicated rows still differ: (game_id, player_id, variants, rows)."""
    return flagged.groupBy("game_id", "player_id").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("rows")
    ).where("variants > 1")


def appearance_id_violations(flagged: DataFrame) -> DataFrame:
    """Null or repeated appearance ids among the deduplicated rows."""
    return C.key_violations(flagged, "appearance_id")


def appearance_stats(flagged: DataFrame) -> DataFrame:
    ok = ~F.col("invalid")
    return flagged.agg(
        F.count(F.when(ok, 1)).alias("league_appearances"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_duplicates_removed"),
        F.count(F.when(~ok, 1)).alias("invalid_stat_rows_removed"),
        F.count(F.when(ok & F.col("date_mismatch"), 1)).alias("appearance_vs_game_date_mismatch"),
    )


def clean_lineups(raw: DataFrame, games: DataFrame) -> DataFrame:
    typed = raw.select(
        S.clean_id("game_id").alias("game_id"),
        S.clean_id("player_id").alias("player_id"),
        F.col("position").cast("string").alias("lineup_position_raw"),
    )
    return (
        typed.join(games.select("game_id"), "game_id", "left_semi")
        .distinct()
        .withColumn("lineup_position", S.map_codes("lineup_position_raw", S.LINEUP_GROUPS))
    )


def lineup_conflicts(lineups: DataFrame) -> DataFrame:
    """(game, player) pairs with more than one raw label: (game_id, player_id, variants, rows)."""
    return C.key_conflicts(lineups, ["game_id", "player_id"], ["lineup_position_raw"])


def unmapped_labels(lineups: DataFrame, label: str, mapped: str) -> DataFrame:
    return lineups.where(F.col(mapped).isNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def clean_valuations(raw: DataFrame) -> DataFrame:
    return (
        raw.select(
            S.clean_id("player_id").alias("player_id"),
            S.parse_date("date").alias("valuation_date"),
            S.to_number("market_value_in_eur").alias("market_value_eur"),
        )
        .na.drop()
        .where("market_value_eur > 0")
    )


def ingest(raw: Mapping[str, DataFrame], competition_ids: Sequence[str]) -> dict[str, DataFrame]:
    """Canonical games, players, moves, appearances and lineups; a broken contract fails the run.

    raw holds `games`, `players`, `transfers` (with source_row), `appearances` and `game_lineups`. Each cleaned
    table is landed once; its contracts and all later steps read that. The contracts, in this order: game ids are
    unique; games of the competitions have a season and a date; player ids are there and unique; a
    move's key has one fee and season; a (game, player) has one appearance and appearance ids are unique; a
    (game, player) has one lineup label, a null beside a label being two.
    """
    ids = land(raw["games"].select(S.clean_id("game_id").alias("game_id")), "game-ids")
    C.require_none(C.key_violations(ids, "game_id").where("problem = 'duplicate_key'"), "games.game_id is not unique")
    games = land(clean_games(raw["games"], competition_ids), "games")
    C.require_none(games.where("season_id is null or match_date is null"), "games of the competitions without season or date")
    players = land(clean_players(raw["players"]), "players")
    C.require_none(C.key_violations(players, "player_id"), "players.player_id is null or not unique")
    typed = land(type_transfers(raw["transfers"]), "typed-moves")
    C.require_none(transfer_conflicts(typed), "moves with one key and several fees or seasons")
    moves = land(with_transfer_id(C.first_per_key(typed, [*TRANSFER_KEY, "raw_fee", "transfer_season"], "source_row")), "moves")
    flagged = land(clean_appearances(raw["appearances"], games)[0], "appearances")
    C.require_none(appearance_conflicts(flagged), "appearances of one game and player that differ")
    C.require_none(appearance_id_violations(flagged), "appearances.appearance_id is null or not unique")
    valid = flagged.where("not invalid").drop("invalid", "date_mismatch", "copies", "appearance_date")
    lineups = land(clean_lineups(raw["game_lineups"], games), "lineups")
    C.require_none(lineup_conflicts(lineups), "lineup labels of one game and player that differ")
    return {"games": games, "players": players, "moves": moves, "appearances": valid, "lineups": lineups}
