"""One registered query per operator over the star-schema tables, with its DuckDB twin.

``@query(name, oracle_text)`` registers a function (Tables -> DataFrame). Dates and nullable
integers are shown as text and doubles through ``stable_round`` so both engines print alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake import bindings as B
from pitlake.functions import scalar as S
from pitlake.functions.landing import discard, land, shared_folder
from pitlake.operators import asof as A
from pitlake.operators import boosting as GB
from pitlake.operators import cleaning as K
from pitlake.operators import conformal as CF
from pitlake.operators import contracts as C
from pitlake.operators import evaluate as E
from pitlake.operators import facts as FX
from pitlake.operators import labels as L
from pitlake.operators import learn as M
from pitlake.operators import seasons as T
from pitlake.operators import split as P
from pitlake.plans import study as ST
from pitlake.sources import raw as RAW
from registry.oracle import (
    AGE, FIT, GRID, GROUP, GROUPS, LABELS, LOOKBACK, NUMBERS, R, agg_sql, asof_sql, cand_sql, pairs_sql, sql,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[B.Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(B.Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return register


def txt(c: Column | str, name: str | None = None) -> Column:
    c2 = F.col(c) if isinstance(c, str) else c
    return c2.cast("string").alias(name or c)


def stable_round(c: Column | str, digits: int) -> Column:
    """Round for the side-by-side display, cutting off the decimal midpoints.

    Averages of two-decimal money often land exactly on x.xx5, where the last bit of the sum
    (which depends on summation order) would decide. The cut at .5679 keeps such values whole.
    """
    scale = 10.0**digits
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.4321) / F.lit(scale)


def rnd(c: Column | str, d: int, name: str | None = None) -> Column:
    return stable_round(c, d).alias(name or c)


def big(c: Column | str, name: str | None = None) -> Column:
    c2 = F.col(c) if isinstance(c, str) else c
    return c2.cast("bigint").alias(name or c)


# ---------------------------------------------------------------- sources, sinks, verification


@query(
    "S1_typed_scan",
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS "
    "l_linenumber, l_quantity, l_returnflag FROM lineitem",
)
def s1(t):
    return RAW.typed_scan(
        t.read("lineitem"),
        {"l_orderkey": "string", "l_linenumber": "string", "l_quantity": "double",
         "l_returnflag": "string"},
    )


@query(
    "S1_csv_scan",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '"' || p_name || '", ' || p_brand ||
    CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'second line' ELSE '' END AS p_name,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type FROM part""",
)
def s1_csv(t):
    name = F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand", F.when(F.col("p_partkey") % 5 == 0, "\nsecond line").otherwise(""))
    rows = t.read("part").select(
        F.col("p_size"), F.col("p_partkey"), name.alias("p_name"),
        F.when(F.col("p_partkey") % 7 == 0, F.element_at(F.array(*(F.lit(x) for x in ("NA", "n/a", "NULL"))), (F.col("p_partkey") % 3 + 1).cast("int")))
        .otherwise(F.col("p_type")).alias("p_type"))
    path = f"{shared_folder(t.spark)}/parts-{uuid.uuid4().hex}"
    rows.write.options(header=True, escape='"', quote='"').csv(path)
    return RAW.read_csv_text(t.spark, path, ["p_partkey", "p_name", "p_type"])


_PROFILE = [
    ("moves", "moves_raw", ["player_id", "from_club_id", "transfer_fee", "transfer_date"]),
    ("players", "players", ["player_id", "date_of_birth", "current_position"]),
    ("lineups", "lineups_raw", ["game_id", "position"]),
]


@query(
    "S2_schema_profile",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, TRUE AS present, count(*) AS rows, "
        f"{R(f'1 - count({c}) / count(*)', 6)} AS null_share FROM {src}"
        for n, src, cols in _PROFILE
        for c in cols
    )
    + " UNION ALL SELECT 'lineups', 'not_there', FALSE, count(*), NULL FROM lineups_raw",
)
def s2(t):
    frames = {"moves": B.raw_moves(t), "players": B.players(t), "lineups": B.lineups(t)}
    wanted = {n: (frames[n], list(cols)) for n, _, cols in _PROFILE}
    wanted["lineups"][1].append("not_there")
    return RAW.schema_profile(wanted).withColumn("null_share", rnd("null_share", 6))


@query(
    "S3_context_scan",
    """SELECT CAST(competition_id AS VARCHAR) AS competition_id, count(*) AS rows,
    sum(minutes) AS minutes, CAST(sum(goals) AS DOUBLE) AS goals
    FROM (SELECT a.*, unnest(range(CASE WHEN game_id % 6 = 0 THEN 2 ELSE 1 END)) FROM (
      SELECT competition_id, game_id, player_id, goals,
      CASE WHEN game_id % 3 = 0 AND l_linenumber = 7 THEN NULL
           WHEN game_id % 4 = 0 AND l_linenumber = 6 THEN -1 ELSE minutes END AS minutes
      FROM apps_all WHERE game_id % 101 <> 0) a)
    WHERE minutes IS NOT NULL AND player_id IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def s3(t):
    wanted = t.read("customer").select(F.col("c_custkey").cast("string").alias("player_id"))
    return (
        RAW.context_scan(B.raw_appearances(t), wanted)
        .groupBy("competition_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("minutes").alias("minutes"),
             F.sum("goals").alias("goals"))
    )


@query(
    "S4_parquet_round_trip",
    "SELECT season_id, count(*) AS rows, CAST(sum(played::INT) AS BIGINT) AS played "
    "FROM games_all GROUP BY season_id",
)
def s4(t):
    path = f"{shared_folder(t.spark)}/games-{uuid.uuid4().hex}"
    RAW.write_table(B.all_games(t), path)
    return RAW.read_table(t.spark, path).groupBy("season_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("played").cast("bigint")).alias("played")
    )


@query(
    "S5_hash_verification",
    "SELECT * FROM (VALUES ('nation.parquet', 'unrecorded'), ('region.parquet', 'differs'), ('lost.parquet', 'missing')) v(file, problem)",
)
def s5(t):
    actual = land(RAW.table_hashes(RAW.file_hashes(t.spark, f"{t.folder}/*.parquet")), "hashes")
    recorded = actual.where("file <> 'nation.parquet'").withColumn(
        "sha256", F.when(F.col("file") == "region.parquet", F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    gone = recorded.where("file = 'orders.parquet'").select(F.lit("lost.parquet").alias("file"), "bytes", "sha256")
    return RAW.verify_hashes(actual, recorded.unionByName(gone))


_FP = (
    "SELECT '{0}' AS table_name, count(*) AS rows, CAST(sum(('0x' || substr(md5({1}), 1, 8))"
    "::BIGINT) AS VARCHAR) AS content_sum FROM {0}"
)


@query(
    "S6_fingerprint",
    _FP.format(
        "orders",
        "CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus "
        "|| '|' || CAST(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS VARCHAR) || '|' || "
        "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
    )
    + " UNION ALL "
    + _FP.format(
        "players",
        "CAST(player_id AS VARCHAR) || '|' || coalesce(CAST(date_of_birth AS VARCHAR), '\\N') || "
        "'|' || coalesce(current_position, '\\N')",
    ),
)
def s6(t):
    orders = RAW.fingerprint(
        t.read("orders"),
        [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"),
         F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint"), F.col("o_orderdate").cast("date")],
    )
    people = RAW.fingerprint(
        B.players(t), [F.col("player_id"), F.col("date_of_birth"), F.col("current_position")]
    )
    return orders.select(F.lit("orders").alias("table_name"), "*").unionByName(
        people.select(F.lit("players").alias("table_name"), "*")
    )


@query(
    "S7_row_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {src}"
        for n, src in (("moves", "moves"), ("players", "players"), ("games", "games"),
                       ("appearances", "apps"), ("lineups", "lineups"), ("seasons", "seasons"))
    ),
)
def s7(t):
    games = B.league_games(t)
    return RAW.row_counts(
        {"moves": B.moves(t), "players": B.players(t), "games": games,
         "appearances": B.appearances(t), "lineups": B.clean_lineup_rows(t),
         "seasons": T.season_table(games, B.expected_games(games))}
    )


# ------------------------------------------------------------- parsing and scalar functions


@query(
    "P1_parse_date",
    """SELECT source_row, CAST(CAST(TRY_CAST(x AS TIMESTAMP) AS DATE) AS VARCHAR) AS transfer_date
    FROM (SELECT source_row, CASE WHEN order_key % 3 = 0 THEN transfer_date || ' 00:00:00'
    ELSE transfer_date END AS x FROM moves_raw)""",
)
def p1(t):
    raw = F.when(
        F.col("order_key") % 3 == 0, F.concat("transfer_date", F.lit(" 00:00:00"))
    ).otherwise(F.col("transfer_date"))
    return B.raw_moves(t).select("source_row", txt(S.parse_date(raw), "transfer_date"))


@query("P2_clean_id", "SELECT source_row, nullif(trim(player_id), '') AS player_id FROM moves_raw")
def p2(t):
    return B.raw_moves(t).select("source_row", S.clean_id("player_id").alias("player_id"))


@query("P3_surrogate_key", "SELECT source_row, transfer_id FROM moves_typed")
def p3(t):
    return K.with_transfer_id(K.type_transfers(B.raw_moves(t))).select("source_row", "transfer_id")


@query("P4_fee_classes", "SELECT source_row, fee_class, fee_eur FROM moves_typed")
def p4(t):
    return B.raw_moves(t).select(
        "source_row", S.fee_class("transfer_fee").alias("fee_class"),
        S.fee_value("transfer_fee").alias("fee_eur"),
    )


@query(
    "P5_code_mapping",
    f"SELECT position, {GROUP.format('position')} AS grp, count(*) AS rows FROM lineups_raw GROUP BY ALL",
)
def p5(t):
    grp = S.map_codes("position", S.LINEUP_GROUPS).alias("grp")
    return B.lineups(t).groupBy("position", grp).agg(F.count(F.lit(1)).alias("rows"))


_RAW_APPS = """(SELECT a.*, unnest(range(CASE WHEN game_id % 6 = 0 THEN 2 ELSE 1 END)) AS copy,
    game_id || '_' || player_id || '_' || l_linenumber AS appearance_id,
    CASE WHEN game_id % 3 = 0 AND l_linenumber = 7 THEN 'n/a'
         WHEN game_id % 4 = 0 AND l_linenumber = 6 THEN '-1' ELSE CAST(minutes AS VARCHAR) END
      AS minutes_played,
    CASE WHEN game_id % 101 <> 0 THEN ship_date END AS appearance_date FROM {0} a)"""


@query(
    "P6_numeric_coerce",
    f"""SELECT season_id, count(*) AS rows, count(TRY_CAST(minutes_played AS DOUBLE)) AS numeric_rows,
    sum(TRY_CAST(minutes_played AS DOUBLE)) AS total FROM {_RAW_APPS.format('apps_all')} GROUP BY 1""",
)
def p6(t):
    n = S.to_number("minutes_played")
    games = B.all_games(t).select(F.col("game_id").cast("string").alias("game_id"), "season_id")
    rows = B.raw_appearances(t).withColumn("game_id", F.trim("game_id"))
    return rows.join(games, "game_id").groupBy("season_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(n).alias("numeric_rows"), F.sum(n).alias("total")
    )


@query(
    "P7_played_flag",
    "SELECT season_id, home_club_goals IS NOT NULL AND away_club_goals IS NOT NULL AS played, "
    "count(*) AS rows FROM games_all GROUP BY ALL",
)
def p7(t):
    played = S.both_present("home_club_goals", "away_club_goals").alias("played")
    return B.all_games(t).drop("played").groupBy("season_id", played).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "P8_competition_filter",
    "SELECT CAST(competition_id AS VARCHAR) AS competition_id, season_id, count(*) AS rows, "
    "min(CAST(match_date AS VARCHAR)) AS first_match FROM games_all WHERE competition_id % 5 <= 2 "
    "GROUP BY ALL",
)
def p8(t):
    ids = [str(i) for i in B.study_competition_ids()]
    return K.clean_games(B.raw_games(t), ids).groupBy("competition_id", "season_id").agg(
        F.count(F.lit(1)).alias("rows"), txt(F.min("match_date"), "first_match")
    )


@query(
    "P9_floor_age",
    f"""SELECT o_orderkey, CAST({AGE.format('date_of_birth', 'o_orderdate')} AS VARCHAR) AS age
    FROM orders JOIN players ON o_custkey = player_id""",
)
def p9(t):
    o = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("player_id"),
                                F.col("o_orderdate").cast("date").alias("d"))
    return o.join(B.players(t), "player_id").select(
        "o_orderkey", txt(S.floor_age("date_of_birth", "d"), "age")
    )


@query(
    "P10_per_90",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {R('CASE WHEN l_quantity >= 10 THEN 90.0::DOUBLE * l_discount / l_quantity END', 6)} AS rate
    FROM lineitem""",
)
def p10(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        rnd(S.per_90("l_discount", "l_quantity", 10.0), 6, "rate"),
    )


@query("P11_log_target", f"SELECT o_orderkey, {R('ln(1 + o_totalprice)', 6)} AS fee_log1p FROM orders")
def p11(t):
    return t.read("orders").select("o_orderkey", rnd(F.log1p("o_totalprice"), 6, "fee_log1p"))


@query(
    "P12_retransform",
    f"""SELECT l_returnflag, count(*) AS rows, CAST(sum((exp(p) - 1 < 0)::INT) AS BIGINT) AS clamped,
    {R('avg(greatest(exp(p) - 1, 0))', 4)} AS mean_value FROM (
    SELECT l_returnflag, (l_quantity - 10) / 5.0 AS p FROM lineitem) GROUP BY 1""",
)
def p12(t):
    p = t.read("lineitem").select("l_returnflag", ((F.col("l_quantity") - 10) / 5.0).alias("p"))
    return p.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(S.clamped("p"), 1)).alias("clamped"),
        rnd(F.avg(S.back_to_units("p")), 4, "mean_value"),
    )


_NAMES = """(SELECT c_custkey AS k, c_custkey AS player_id, CASE WHEN c_custkey % 3 = 0
    THEN 'Customer #common ' || (c_custkey % 5) ELSE replace(c_name, '#', ' #') END AS name
    FROM customer)"""
_REQ = f"""(SELECT k AS request_id, name AS own,
    CASE WHEN k % 4 = 0 THEN k + CASE WHEN k % 8 = 0 THEN 1000000000 ELSE 0 END END AS want_id,
    CASE k % 4 WHEN 1 THEN name
      WHEN 2 THEN '  ' || upper(replace(replace(name, 'u', 'ü'), '#', '  #'))
      WHEN 3 THEN 'Nobody ' || name END AS want_name FROM {_NAMES})"""
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"


@query(
    "P14_name_normalise",
    f"""SELECT request_id, {_NORM.format('want_name')} = {_NORM.format('own')} AS same_name
    FROM {_REQ} WHERE want_name IS NOT NULL""",
)
def p14(t):
    own = B.player_names(t).select(F.col("c_custkey").alias("request_id"), F.col("name").alias("own"))
    return (
        B.name_requests(t).where("want_name is not null").join(own, "request_id")
        .select("request_id", (S.name_key("want_name") == S.name_key("own")).alias("same_name"))
    )


@query(
    "P15_match_points",
    "SELECT season_id, points, count(*) AS rows FROM points GROUP BY ALL",
)
def p15(t):
    rows = A.with_points(B.appearances(t), B.league_games(t))
    return rows.groupBy("season_id", "points").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "P16_clean_valuations",
    f"SELECT player_id, count(*) AS rows, {R('sum(market_value_eur)', 2)} AS total FROM vals GROUP BY 1",
)
def p16(t):
    raw = B.valuations(t).select(
        F.concat(F.lit(" "), F.col("player_id").cast("string")).alias("player_id"),
        F.col("valuation_date").cast("string").alias("date"),
        F.col("market_value_eur").cast("string").alias("market_value_in_eur"),
    )
    return K.clean_valuations(raw).groupBy(big("player_id")).agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.sum("market_value_eur"), 2, "total")
    )


# -------------------------------------------------------------- contracts, dedup, identity


@query(
    "Q1_exact_duplicates",
    """SELECT CAST(player_id AS VARCHAR) AS player_id, count(*) AS kept,
    CAST(sum(copies) - count(*) AS BIGINT) AS removed, min(source_row) AS first_row FROM (SELECT player_id, min(source_row) AS source_row, count(*) AS copies
    FROM moves_typed GROUP BY player_id, transfer_date, from_club_id, to_club_id, raw_fee,
    transfer_season) GROUP BY player_id""",
)
def q1(t):
    one = K.clean_transfers(B.raw_moves(t))
    return one.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.col("copies") - 1).alias("removed"),
        F.min("source_row").alias("first_row"),
    )


@query(
    "Q2_key_conflicts",
    """SELECT l_orderkey, l_linenumber, count(*) AS variants, CAST(sum(n) AS BIGINT) AS rows FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) AS n
    FROM lineitem GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1""",
)
def q2(t):
    return C.key_conflicts(
        t.read("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]
    )


_DEDUP_APPS = f"""(SELECT game_id, player_id, minutes_played, goals, assists, yellow_cards, red_cards,
    count(*) AS copies, min(appearance_id) AS appearance_id,
    arg_min(appearance_date, appearance_id || ' ' || coalesce(CAST(appearance_date AS VARCHAR), ''))
      AS appearance_date, any_value(match_date) AS match_date
    FROM {_RAW_APPS.format('apps')} GROUP BY ALL)"""


def _deduped(t):
    games = K.clean_games(B.raw_games(t), [str(i) for i in B.study_competition_ids()])
    return K.clean_appearances(B.raw_appearances(t), games)


@query(
    "Q3_appearance_dedup",
    f"""SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(player_id AS VARCHAR) AS player_id,
    count(*) AS variants, CAST(sum(copies) AS BIGINT) AS rows FROM {_DEDUP_APPS}
    GROUP BY ALL HAVING count(*) > 1""",
)
def q3(t):
    flagged, _ = _deduped(t)
    return K.appearance_conflicts(flagged)


_INVALID = "coalesce(TRY_CAST(minutes_played AS DOUBLE) < 0, TRUE)"


@query(
    "Q4_invalid_stats",
    f"""SELECT count(*) FILTER (NOT {_INVALID}) AS valid_rows, count(*) FILTER ({_INVALID}) AS
    invalid_rows, CAST(sum(copies - 1) AS BIGINT) AS duplicates FROM {_DEDUP_APPS}""",
)
def q4(t):
    flagged, _ = _deduped(t)
    return K.appearance_stats(flagged).select(
        F.col("league_appearances").alias("valid_rows"),
        F.col("invalid_stat_rows_removed").alias("invalid_rows"),
        F.col("exact_duplicates_removed").alias("duplicates"),
    )


@query(
    "Q5_date_mismatch",
    f"""SELECT count(*) FILTER (NOT {_INVALID} AND appearance_date IS DISTINCT FROM match_date)
    AS mismatches, count(*) FILTER (NOT {_INVALID}) AS rows FROM {_DEDUP_APPS}""",
)
def q5(t):
    flagged, _ = _deduped(t)
    return K.appearance_stats(flagged).select(
        F.col("appearance_vs_game_date_mismatch").alias("mismatches"),
        F.col("league_appearances").alias("rows"),
    )


@query(
    "Q6_key_contracts",
    """SELECT nullif(trim(player_id), '') AS k, count(*) AS rows,
    CASE WHEN nullif(trim(player_id), '') IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS problem
    FROM moves_raw GROUP BY 1 HAVING count(*) > 1 OR nullif(trim(player_id), '') IS NULL""",
)
def q6(t):
    ids = B.raw_moves(t).select(S.clean_id("player_id").alias("k"))
    return C.key_violations(ids, "k")


@query(
    "Q7_lineup_conflicts",
    f"""SELECT CAST(l_orderkey % 499 AS VARCHAR) AS game_id, CAST(l_partkey AS VARCHAR) AS player_id,
    count(DISTINCT coalesce(p, '')) AS variants, count(DISTINCT coalesce(p, '')) AS rows FROM (SELECT *,
    {LABELS}[CAST((l_orderkey * 7 + l_partkey * 3) % 20 + 1 AS BIGINT)] AS p FROM lineitem)
    GROUP BY ALL HAVING count(DISTINCT coalesce(p, '')) > 1""",
)
def q7_conflicts(t):
    rows = t.read("lineitem").select(
        (F.col("l_orderkey") % 499).alias("game_id"), F.col("l_partkey").alias("player_id"),
        B.lineup_label(F.col("l_orderkey"), F.col("l_partkey")).alias("position"))
    games = rows.select(F.col("game_id").cast("string").alias("game_id")).distinct()
    return K.lineup_conflicts(K.clean_lineups(rows, games))


@query(
    "Q7_unmapped_labels",
    f"""SELECT position AS lineup_position_raw, count(*) AS rows FROM (SELECT DISTINCT r.* FROM
    lineups_raw r JOIN games g ON r.game_id = g.game_id)
    WHERE {GROUP.format('position')} IS NULL GROUP BY 1""",
)
def q7(t):
    games = B.league_games(t).select(F.col("game_id").cast("string").alias("game_id"))
    return K.unmapped_labels(
        K.clean_lineups(B.lineups(t), games), "lineup_position_raw", "lineup_position"
    )


@query(
    "Q8_reference_check",
    """SELECT x.competition_id, x.competition_code, x.type, n.n_name AS actual_competition_code,
    CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_regionkey = 3 THEN 'international_cup'
      ELSE 'domestic_league' END AS actual_type,
    CASE WHEN n_nationkey IS NULL THEN 'absent' ELSE 'differs' END AS problem
    FROM (SELECT s_suppkey AS competition_id, 'NATION_' || s_nationkey AS competition_code,
          'domestic_league' AS type FROM supplier) x
    LEFT JOIN nation n ON x.competition_id = n_nationkey
    WHERE n_nationkey IS NULL OR n_name <> x.competition_code OR n_regionkey = 3""",
)
def q8(t):
    expected = t.read("supplier").select(
        F.col("s_suppkey").alias("competition_id"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("competition_code"),
        F.lit("domestic_league").alias("type"),
    )
    return C.reference_mismatches(expected, B.competitions(t), "competition_id")


@query(
    "Q9_capabilities",
    f"""SELECT 'moves_with_player' AS metric, {R('count(player_id) / count(*)', 6)} AS value FROM moves
    UNION ALL SELECT 'moves_with_date', {R('count(transfer_date) / count(*)', 6)} FROM moves
    UNION ALL SELECT 'any_paid', max((fee_class = 'paid')::INT)::DOUBLE FROM moves
    UNION ALL SELECT 'unique_move_keys', (count(*) = count(DISTINCT transfer_id))::INT::DOUBLE FROM moves
    UNION ALL SELECT 'unique_players', (count(*) = count(DISTINCT player_id))::INT::DOUBLE FROM players
    UNION ALL SELECT 'birth_date_share', {R('count(date_of_birth) / count(*)', 6)} FROM players
    UNION ALL SELECT 'appearances_dated', {R('count(match_date) / count(*)', 6)} FROM apps
    UNION ALL SELECT 'appearances_in_season', {R('count(season_id) / count(*)', 6)} FROM apps
    UNION ALL SELECT 'appearance_rows', count(*)::DOUBLE FROM apps
    UNION ALL SELECT 'any_complete_season', max(complete::INT)::DOUBLE FROM seasons
    UNION ALL SELECT 'lineup_share', {R('count(lineup_position) / count(*)', 6)} FROM hist""",
)
def q9(t):
    games = B.league_games(t)
    history = A.enrich_history(B.appearances(t), B.clean_lineup_rows(t))
    found = C.capabilities(B.moves(t), B.players(t), history, T.season_table(games, B.expected_games(games)))
    return found.withColumn("value", rnd("value", 6))


@query(
    "Q10_row_gates",
    """SELECT gate, required, actual, actual >= required AS passed FROM (
    SELECT 'total_rows' AS gate, 200::BIGINT AS required, (SELECT count(*) FROM feats) AS actual
    UNION ALL SELECT 'test_rows', 100000000, (SELECT count(*) FROM test)
    UNION ALL SELECT 'usable_folds', 3, (SELECT count(*) FROM (SELECT val,
      (SELECT count(*) FROM train t WHERE t.transfer_cycle < val) AS tr,
      (SELECT count(*) FROM train t WHERE t.transfer_cycle = val) AS va FROM folds)
      WHERE tr >= 80 AND va >= 20))""",
)
def q10(t):
    feats, _ = ST.landed_features(t)
    counts = feats.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col("partition") == "test", 1)).alias("test_rows"),
    )
    folds = P.fold_summary(feats.where("partition = 'train'"), B.N_FOLDS, 80, 20)
    usable = folds.agg(F.count(F.when(F.col("usable"), 1))).scalar()
    return C.gates(
        counts.withColumn("usable_folds", usable),
        {"total_rows": 200, "test_rows": 100_000_000, "usable_folds": 3},
    )


@query(
    "Q11_window_drift",
    """SELECT name, CAST(d AS VARCHAR) AS derived, p AS pinned FROM (
    SELECT 'transfer_start' AS name, s AS d, '1995-12-01' AS p FROM win
    UNION ALL SELECT 'transfer_end_exclusive', e, '2001-07-01' FROM win
    UNION ALL SELECT 'test_start', t, '2000-07-01' FROM win) WHERE CAST(d AS VARCHAR) <> p""",
)
def q11(t):
    games = B.league_games(t)
    seasons = T.season_table(games, B.expected_games(games))
    pinned = t.spark.createDataFrame(
        [("transfer_start", "1995-12-01"), ("transfer_end_exclusive", "2001-07-01"),
         ("test_start", "2000-07-01")], "name string, value string",
    )
    return C.drift(T.study_window(seasons, B.STUDY_SEASONS), pinned, "name", "value")


@query(
    "Q12_finite_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, "
        f"count(*) FILTER ({c} IS NULL OR NOT isfinite({c}::DOUBLE)) AS bad FROM candidates"
        for c in ("goals", "minutes", "goals_per90", "age", "lookback_match_count")
    ),
)
def q12(t):
    cols = ["goals", "minutes", "goals_per90", "age", "lookback_match_count"]
    return C.non_finite_counts(ST.candidates(ST.bound_inputs(t)), cols)


@query(
    "Q13_round_trips",
    """SELECT DISTINCT l.order_key FROM (SELECT *, """
    + """CASE WHEN player_id IS NULL OR transfer_date IS NULL OR transfer_date < s OR
    transfer_date >= e THEN 1 ELSE 0 END AS out_ FROM moves3 CROSS JOIN win) l
    JOIN moves3 b ON b.player_id = l.player_id AND b.from_club_id IS NOT DISTINCT FROM l.to_club_id
    AND b.to_club_id IS NOT DISTINCT FROM l.from_club_id
    AND b.fee_class IN ('zero_fee', 'undisclosed')
    AND b.transfer_date > l.transfer_date AND b.transfer_date <= l.transfer_date + 400
    WHERE l.out_ = 0 AND l.fee_class = 'paid'""",
)
def q13(t):
    i = ST.bound_inputs(t)
    moves = B.moves(t, clubs=(3, 3))
    labeled = L.labels(L.with_label_reason(moves, i.start, i.end))
    return L.round_trips(labeled, moves).select(F.floor(F.col("source_row") / 2).alias("order_key"))


def _with_later(table: str) -> str:
    """History plus one later or same-day copy per label, tagged with a lookback season."""
    return f"""(SELECT * FROM {table} UNION ALL SELECT -1 - c.source_row AS game_id, c.player_id,
    k.completed_1 AS season_id, c.transfer_date + CAST(c.source_row % 2 AS INT) AS match_date,
    0 AS competition_id, 0 AS club_id, 90.0 AS minutes, 5 AS goals, 5 AS assists, 0 AS yellow_cards,
    0 AS red_cards, c.transfer_date AS ship_date, 1 AS l_linenumber, 'GK' AS lineup_position
    FROM last_label c JOIN lookback k ON c.transfer_date = k.d WHERE coverage_ok)"""


_LAST_LABEL = (
    "SELECT player_id, max(transfer_date) AS transfer_date, min(source_row) AS source_row "
    "FROM labeled GROUP BY player_id"
)


def _leak_oracle() -> str:
    hist2 = _with_later("hist").replace("last_label", f"({_LAST_LABEL})")
    pairs2 = f"({pairs_sql('labeled', hist2)})"
    again = cand_sql("labeled", f"({agg_sql(pairs2)})")
    cols = "transfer_id, goals, minutes, lookback_match_count, last_match_date, position"
    return f"""SELECT 'history_on_or_after_cutoff' AS check_name,
    count(*) FILTER (last_match_date >= transfer_date) AS violations FROM feats
    UNION ALL SELECT 'keys_on_both_sides', (SELECT count(*) FROM (SELECT transfer_id FROM train
      INTERSECT SELECT transfer_id FROM test))
    UNION ALL SELECT 'changed_by_later_rows', (SELECT count(*) FROM (SELECT {cols} FROM candidates
      EXCEPT ALL SELECT {cols} FROM ({again})))"""


@query("Q14_leakage_audit", _leak_oracle())
def q14(t):
    i = ST.bound_inputs(t, names=False)
    cols = ["goals", "minutes", "lookback_match_count", "last_match_date", "position"]
    # Both tables read the same labels and the same history with its lineup labels, so each of these is made once. Steps are
    # landed one by one: the shuffles and tables of a step go before the next.
    i = replace(i, moves=i.moves.select("transfer_id", "source_row", *ST.MOVE_COLUMNS))
    labeled = ST.landed_labels(i, "transfer_id", "source_row")
    rows = land(i.appearances.select("game_id", "player_id", "season_id", "match_date", "minutes", "goals", "assists"), "appearances")
    history = land(A.enrich_history(rows, i.lineups), "history")
    discard(rows)

    def build(history):
        daily = land(A.history_totals(history), "daily")
        made = ST.candidates(i, labeled, daily).select("transfer_id", "transfer_date", "feature_exclusion_reason", *cols)
        made = land(made, "candidates")
        discard(daily)
        return made

    feats = build(history)
    ok = P.with_partition(A.usable_features(feats), "transfer_date", i.test_start)
    last = labeled.groupBy("player_id").agg(F.max("transfer_date").alias("transfer_date"), F.min("source_row").alias("source_row"))
    seen = T.attach_lookback(last, "transfer_date", i.seasons, B.SOURCE_SEASONS).where("coverage_ok").select(
        "player_id", "transfer_date", "source_row", "completed_1")
    later = C.later_rows(seen, "player_id", "transfer_date", "match_date", {
        "game_id": -1 - F.col("source_row"), "season_id": F.col("completed_1"), "minutes": F.lit(90.0), "goals": F.lit(5),
        "assists": F.lit(5), "lineup_position": F.lit("GK")})
    leaks = C.future_leaks(build, history, later, ["transfer_id"], cols, feats)
    return C.leakage_audit(ok, leaks, "transfer_id", "transfer_date", "last_match_date", "partition")


# ------------------------------------------------------------------- seasons and lookback


@query(
    "T1_season_table",
    """SELECT season_id, CAST(first_match AS VARCHAR) AS first_match, CAST(last_match AS VARCHAR) AS
    last_match, n_games, n_played, expected_games, complete FROM seasons""",
)
def t1(t):
    games = B.league_games(t)
    return T.season_table(games, B.expected_games(games)).select(
        "season_id", txt("first_match"), txt("last_match"), "n_games", "n_played",
        big("expected_games"), "complete",
    )


def _seasons(t):
    games = B.league_games(t)
    return T.season_table(games, B.expected_games(games))


@query(
    "T2_transfer_cycles",
    "SELECT season_id, CAST(cycle_start AS VARCHAR) AS cycle_start, CAST(cycle_end AS VARCHAR) AS "
    "cycle_end_exclusive FROM cycles",
)
def t2(t):
    return T.transfer_cycles(_seasons(t)).select(
        "season_id", txt("cycle_start"), txt("cycle_end_exclusive")
    )


@query(
    "T3_cycle_of_date",
    """SELECT o_orderkey, CAST(season_id AS VARCHAR) AS cycle FROM orders LEFT JOIN cycles
    ON o_orderdate >= cycle_start AND o_orderdate < cycle_end""",
)
def t3(t):
    o = t.read("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return T.with_cycle(o, "d", T.transfer_cycles(_seasons(t)), "cycle").select(
        "o_orderkey", txt("cycle")
    )


@query(
    "T4_resolve_lookback",
    "SELECT CAST(d AS VARCHAR) AS cutoff, CAST(completed_1 AS VARCHAR) AS completed_1, "
    "CAST(completed_2 AS VARCHAR) AS completed_2, CAST(ongoing AS VARCHAR) AS ongoing, coverage_ok "
    f"FROM ({LOOKBACK.format('(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)')})",
)
def t4(t):
    days = t.read("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return T.attach_lookback(days, "d", _seasons(t), B.SOURCE_SEASONS).select(
        txt("d", "cutoff"), txt("completed_1"), txt("completed_2"), txt("ongoing"), "coverage_ok"
    )


@query(
    "T5_study_window",
    """SELECT 'transfer_start' AS name, CAST(s AS VARCHAR) AS value FROM win UNION ALL
    SELECT 'transfer_end_exclusive', CAST(e AS VARCHAR) FROM win UNION ALL
    SELECT 'test_start', CAST(t AS VARCHAR) FROM win""",
)
def t5(t):
    return T.study_window(_seasons(t), B.STUDY_SEASONS)


# ------------------------------------------------------------- as-of joins and aggregates


def _labeled(i: ST.Inputs) -> DataFrame:
    return L.labels(L.with_label_reason(i.moves, i.start, i.end))


def _per_season(i: ST.Inputs, cand: DataFrame) -> DataFrame:
    sums = {c: F.col(c) for c in A.STAT_SUMS}
    games = {"lookback_match_count": F.col("game_id")}
    return A.lookback_totals(cand, i.appearances, "player_id", "transfer_date", sums, games)


@query(
    "A1_lookback_join",
    """SELECT transfer_id, season_id, count(DISTINCT game_id) AS matches, sum(minutes) AS minutes,
    CAST(sum(goals) AS BIGINT) AS goals, CAST(max(match_date) AS VARCHAR) AS last_match
    FROM pairs GROUP BY ALL""",
)
def a1(t):
    i = ST.bound_inputs(t)
    cand = T.attach_lookback(_labeled(i), "transfer_date", i.seasons, B.SOURCE_SEASONS)
    per = _per_season(i, cand)
    return cand.select("transfer_id", "player_id", "transfer_date").join(
        per, ["player_id", "transfer_date"]
    ).select(
        "transfer_id", "season_id", F.col("lookback_match_count").alias("matches"), "minutes",
        "goals", txt("last_day", "last_match"),
    )


@query(
    "A2_asof_aggregate",
    """SELECT transfer_id, CAST(goals AS BIGINT) AS goals, CAST(assists AS BIGINT) AS assists, minutes,
    CAST(appearances AS BIGINT) AS appearances, lookback_match_count, CAST(first_match_date AS VARCHAR)
    AS first_match_date, CAST(last_match_date AS VARCHAR) AS last_match_date, lookback_season_ids,
    lineup_position_rows FROM lookagg""",
)
def a2(t):
    rows = ST.candidates(ST.bound_inputs(t)).where("lookback_match_count is not null")
    return rows.select(
        "transfer_id", "goals", "assists", "minutes", "appearances", "lookback_match_count",
        txt("first_match_date"), txt("last_match_date"), "lookback_season_ids", "lineup_position_rows",
    )


@query("A3_mode_position", "SELECT transfer_id, mode_position FROM lookagg WHERE mode_position IS NOT NULL")
def a3(t):
    i = ST.bound_inputs(t)
    cand = T.attach_lookback(_labeled(i), "transfer_date", i.seasons, B.SOURCE_SEASONS)
    hist = A.enrich_history(i.appearances, i.lineups)
    counts = A.position_counts("lineup_position")
    per = A.lookback_totals(cand, hist, "player_id", "transfer_date", counts)
    mode = A.merge_seasons(per, "player_id", "transfer_date", list(counts)).select(
        "player_id", "transfer_date", A.mode_of_counts().alias("mode_position")
    )
    return cand.join(mode, ["player_id", "transfer_date"]).where("mode_position is not null").select(
        "transfer_id", "mode_position"
    )


@query(
    "A4_historical_or_proxy",
    "SELECT transfer_id, position, position_source, position_is_proxy FROM candidates",
)
def a4(t):
    return ST.candidates(ST.bound_inputs(t)).select(
        "transfer_id", "position", "position_source", "position_is_proxy"
    )


@query(
    "A5_history_enrichment",
    """SELECT h.player_id, h.lineup_position, p.current_position, count(*) AS rows, sum(h.minutes) AS
    minutes FROM hist h LEFT JOIN players p ON h.player_id = p.player_id GROUP BY ALL""",
)
def a5(t):
    rows = A.enrich_history(B.appearances(t), B.clean_lineup_rows(t))
    profile = B.players(t).select("player_id", "current_position")
    return rows.join(profile, "player_id", "left").groupBy(
        "player_id", "lineup_position", "current_position"
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum("minutes").alias("minutes"))


@query("A6_first_failure_reason", "SELECT transfer_id, feature_exclusion_reason FROM candidates")
def a6(t):
    return ST.candidates(ST.bound_inputs(t)).select("transfer_id", "feature_exclusion_reason")


@query(
    "A7_value_asof",
    f"""SELECT transfer_id, market_value_eur, CAST(valuation_date AS VARCHAR) AS valuation_date,
    CAST(age_days AS VARCHAR) AS valuation_age_days, status AS market_value_status
    FROM ({asof_sql('labeled')})""",
)
def a7(t):
    i = ST.bound_inputs(t)
    out = A.asof_latest_by_day(
        _labeled(i), B.clean_values(t), "player_id", "transfer_date", "valuation_date",
        "market_value_eur", B.STALE_DAYS,
    )
    return out.select(
        "transfer_id", "market_value_eur", txt("valuation_date"), txt("valuation_age_days"),
        "market_value_status",
    )


@query(
    "A7_event_asof",
    """SELECT p.event_id, c.value AS prior_value, CAST(c.ts AS VARCHAR) AS prior_at
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click'
      GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts > c.ts""",
)
def a7_events(t):
    ev = t.read("events")
    out = A.asof_latest_by_time(
        ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
        ev.where("event_type = 'click'"), "user_id", "ts", "value",
    )
    return out.select("event_id", "prior_value", txt("prior_at"))


_LEVEL = "SELECT CAST(transfer_date AS VARCHAR) AS transfer_date, {0} AS league_price_level, price_level_transfers FROM level"


@query("A8_trailing_median", _LEVEL.format(R("league_price_level", 6)))
def a8(t):
    feats, i = ST.landed_features(t)
    level = ST.landed_price_level(feats, i, 1)
    return level.select(
        txt("transfer_date"), rnd("league_price_level", 6), "price_level_transfers"
    )


@query("A9_active_moves", "SELECT transfer_id, cycle FROM qualified")
def a9(t):
    return ST.qualifying_moves(ST.bound_inputs(t)).select("transfer_id", "cycle")


def _context(t):
    feats, i = ST.landed_features(t)
    comps = B.competitions(t)
    others = A.other_leagues(comps, comps.where("in_study").select("competition_id"))
    everything = B.appearance_rows(t, B.all_games(t))
    europe = [n for n in range(25) if n % 5 == 3]
    return A.context_columns(
        feats, i.seasons, A.with_points(i.appearances, i.games), everything, others, europe
    )


@query(
    "A10_context_sums",
    "SELECT transfer_id, CAST(lookback_window_start AS VARCHAR) AS lookback_window_start, "
    "europe_minutes, other_league_minutes, other_league_goals FROM ctx",
)
def a10(t):
    return _context(t).select(
        "transfer_id", txt("lookback_window_start"), "europe_minutes", "other_league_minutes",
        "other_league_goals",
    )


@query(
    "A11_other_leagues",
    "SELECT n_nationkey AS competition_id FROM nation WHERE n_regionkey = 4",
)
def a11(t):
    comps = B.competitions(t)
    return A.other_leagues(comps, comps.where("in_study").select("competition_id"))


@query(
    "A12_team_points",
    f"""SELECT f.transfer_id, {R('team_points_per_game', 6)} AS team_points_per_game FROM feats f
    LEFT JOIN team_ppg p ON f.transfer_id = p.transfer_id""",
)
def a12(t):
    feats, i = ST.landed_features(t)
    out = A.team_points(feats, A.with_points(i.appearances, i.games), "player_id", "transfer_date")
    return out.select("transfer_id", rnd("team_points_per_game", 6))


@query("A13_ongoing_share", f"SELECT transfer_id, {R('ongoing_season_share', 6)} AS share FROM exposed")
def a13(t):
    feats, i = ST.landed_features(t)
    return A.ongoing_share(feats, i.games, i.expected).select(
        "transfer_id", rnd("ongoing_season_share", 6, "share")
    )


@query("A14_team_matches", "SELECT season_id, CAST(m AS BIGINT) AS team_matches FROM team_matches")
def a14(t):
    return A.team_matches(B.appearances(t))


@query(
    "A15_exposure",
    "SELECT transfer_id, window_ AS window, "
    + ", ".join(
        f"{R(src, 6)} AS {name}"
        for src, name in (("equivalents", "lookback_season_equivalents"),
                          ("available", "available_team_matches"),
                          ("goals_per_season", "goals_per_season"),
                          ("assists_per_season", "assists_per_season"),
                          ("minutes_share", "minutes_share"), ("appearance_share", "appearance_share"))
    )
    + " FROM exposed",
)
def a15(t):
    feats, i = ST.landed_features(t)
    out = A.exposure_columns(feats, i.games, i.appearances, i.expected)
    cols = ["lookback_season_equivalents", "available_team_matches", *M.EXPOSURE]
    return out.select("transfer_id", "window", *(rnd(c, 6) for c in cols))


@query(
    "A16_cycle_trend",
    "SELECT transfer_id, CAST(transfer_cycle AS DOUBLE) AS cycle_trend FROM feats",
)
def a16(t):
    feats = ST.assemble(ST.bound_inputs(t))
    return feats.select("transfer_id", A.cycle_trend().alias("cycle_trend"))


@query(
    "A17_level_attach",
    f"""SELECT transfer_id, {R('league_price_level', 6)} AS league_price_level, price_level_transfers,
    price_level_transfers < 30 AS below_minimum, 0::BIGINT AS repeated_level_keys
    FROM feats JOIN level USING (transfer_date)""",
)
def a17(t):
    feats, i = ST.landed_features(t)
    level = ST.landed_price_level(feats, i, 30)
    repeated = C.key_violations(level, "transfer_date").agg(F.count(F.lit(1))).scalar()
    return feats.join(F.broadcast(level), "transfer_date", "left").select(
        "transfer_id", rnd("league_price_level", 6), "price_level_transfers", "below_minimum",
        repeated.alias("repeated_level_keys"),
    )


_FEATURE_SELECT = (
    "SELECT transfer_id, CAST(transfer_date AS VARCHAR) AS transfer_date, CAST(goals AS BIGINT) AS goals, "
    "CAST(assists AS BIGINT) AS assists, minutes, CAST(appearances AS BIGINT) AS appearances, "
    f"{R('goals_per90', 6)} AS goals_per90, {R('assists_per90', 6)} AS assists_per90, age, "
    "position, position_source, position_is_proxy, lookback_season_ids, CAST(yellow_cards AS BIGINT) "
    "AS yellow_cards, CAST(red_cards AS BIGINT) AS red_cards{0} FROM "
)


def _feature_columns(*extra):
    return [
        "transfer_id", txt("transfer_date"), "goals", "assists", "minutes", "appearances",
        rnd("goals_per90", 6), rnd("assists_per90", 6), "age", "position", "position_source",
        "position_is_proxy", "lookback_season_ids", "yellow_cards", "red_cards", *extra,
    ]


@query(
    "A18_feature_table",
    _FEATURE_SELECT.format("") + "candidates WHERE feature_exclusion_reason IS NULL",
)
def a18(t):
    return A.usable_features(ST.candidates(ST.bound_inputs(t))).select(*_feature_columns())


_SCORING = """(SELECT 'p' || c_custkey AS transfer_id, c_custkey AS player_id,
    DATE '2000-05-20' + CAST((c_custkey * 7) % 460 AS INT) AS transfer_date FROM customer)"""
_SCORE_LOOK = f"({LOOKBACK.format(f'(SELECT DISTINCT transfer_date AS d FROM {_SCORING})')})"


@query(
    "A19_scoring_set",
    f"""SELECT player_id, CAST(transfer_date AS VARCHAR) AS as_of,
    CASE WHEN transfer_date <= (SELECT max(transfer_date) FROM train)
      THEN 'not_after_last_training_date'
      WHEN transfer_date > (SELECT max(match_date) + 1 FROM games) THEN 'beyond_source_coverage'
      ELSE coalesce(feature_exclusion_reason, 'ok') END AS status, minutes, position
    FROM ({cand_sql(_SCORING, f"({agg_sql('(' + pairs_sql(_SCORING, 'hist', _SCORE_LOOK) + ')')})",
                    _SCORE_LOOK)})""",
)
def a19(t):
    feats, i = ST.landed_features(t)
    built = A.feature_candidates(
        B.scoring_rows(t), i.appearances, i.lineups, i.players, i.seasons, B.SOURCE_SEASONS, B.MIN_MINUTES
    )
    last_train = feats.where("partition = 'train'").agg(F.max("transfer_date")).scalar()
    end = i.games.agg(F.date_add(F.max("match_date"), 1)).scalar()
    guard = A.scoring_guards("transfer_date", last_train, end)
    return built.select(
        "player_id", txt("transfer_date", "as_of"),
        F.coalesce(guard, F.col("feature_exclusion_reason"), F.lit("ok")).alias("status"),
        "minutes", "position",
    )


@query(
    "A20_entity_resolution",
    f"""SELECT request_id, match_kind, matches, CASE WHEN matches = 0 THEN 'unknown' WHEN matches > 1
    THEN 'ambiguous' ELSE 'resolved' END AS status,
    CASE WHEN matches = 1 THEN CAST(hit AS VARCHAR) END AS player_id FROM (
    SELECT request_id, CASE WHEN want_id IS NOT NULL THEN CASE WHEN i.player_id IS NULL THEN 'none'
      ELSE 'id' END WHEN e.n IS NOT NULL THEN 'exact_name' WHEN m.n IS NOT NULL
      THEN 'normalised_name' ELSE 'none' END AS match_kind,
    CASE WHEN want_id IS NOT NULL THEN (i.player_id IS NOT NULL)::INT::BIGINT
      ELSE coalesce(e.n, m.n, 0) END AS matches,
    CASE WHEN want_id IS NOT NULL THEN i.player_id WHEN e.n IS NOT NULL THEN e.p ELSE m.p END AS hit
    FROM {_REQ} r LEFT JOIN {_NAMES} i ON r.want_id = i.player_id
    LEFT JOIN (SELECT name, count(*) AS n, min(player_id) AS p FROM {_NAMES} GROUP BY 1) e
      ON e.name = r.want_name
    LEFT JOIN (SELECT {_NORM.format('name')} AS nn, count(*) AS n, min(player_id) AS p FROM {_NAMES}
      GROUP BY 1) m ON m.nn = {_NORM.format('r.want_name')})""",
)
def a20(t):
    return A.resolve_entities(B.name_requests(t), B.player_names(t)).withColumn(
        "player_id", txt("player_id")
    )


# ------------------------------------------------------------------ labels and the funnel


@query("L1_label_reasons", "SELECT transfer_id, reason AS label_exclusion_reason FROM reasoned")
def l1(t):
    i = ST.bound_inputs(t)
    return L.with_label_reason(i.moves, i.start, i.end).select("transfer_id", "label_exclusion_reason")


@query("L2_labels", f"SELECT transfer_id, fee_eur, {R('fee_log1p', 6)} AS fee_log1p FROM labeled")
def l2(t):
    return _labeled(ST.bound_inputs(t)).select("transfer_id", "fee_eur", rnd("fee_log1p", 6))


@query(
    "L3_label_stats",
    """SELECT 'all_rows' AS scope, coalesce(reason, 'labeled') AS item, count(*) AS rows FROM reasoned
    GROUP BY ALL UNION ALL SELECT 'study_window', fee_class, count(*) FROM reasoned
    WHERE reason IS NULL OR reason NOT IN ('missing_player_id', 'missing_transfer_date',
    'outside_study_window') GROUP BY ALL""",
)
def l3(t):
    i = ST.bound_inputs(t)
    return L.label_stats(L.with_label_reason(i.moves, i.start, i.end))


def _funnel_oracle() -> str:
    names = [(0, "raw_transfer_rows_after_exact_dedup", None)]
    for r in L.LABEL_REASONS:
        names.append((len(names), L.STEP_OF_REASON[r], r))
    for s in L.IMPLIED_STEPS:
        names.append((len(names), s, None))
    for r in A.FEATURE_REASONS:
        names.append((len(names), L.STEP_OF_REASON[r], r))
    names.append((len(names), "final_supervised_rows", None))
    values = ", ".join(f"({p}, '{s}', {'NULL' if r is None else repr(r)})" for p, s, r in names)
    n = len(names)
    return f"""SELECT pos, step, (SELECT count(*) FROM moves) -
    CAST(sum(dropped) OVER (ORDER BY pos) AS BIGINT) AS rows, dropped, reason FROM (
    SELECT pos, step, reason, coalesce((SELECT count(*) FROM reasoned r WHERE r.reason = v.reason), 0)
    + coalesce((SELECT count(*) FROM candidates c WHERE c.feature_exclusion_reason = v.reason), 0)
    AS dropped FROM (VALUES {values}) v(pos, step, reason))
    UNION ALL SELECT {n}, 'train_rows', count(*), 0, NULL FROM train
    UNION ALL SELECT {n + 1}, 'test_rows', count(*), 0, NULL FROM test"""


@query("L4_funnel", _funnel_oracle())
def l4(t):
    i = ST.bound_inputs(t)
    reasoned = L.with_label_reason(i.moves, i.start, i.end)
    cand = land(ST.candidates(i), "candidates")
    return L.funnel(reasoned, cand, i.test_start)


@query(
    "L5_cohort_histograms",
    """SELECT 'position_source' AS item, position_source AS value, count(*) AS rows FROM feats
    GROUP BY ALL UNION ALL SELECT 'transfer_cycle', CAST(transfer_cycle AS VARCHAR), count(*)
    FROM feats GROUP BY ALL""",
)
def l5(t):
    return L.histogram(ST.assemble(ST.bound_inputs(t)), ["position_source", "transfer_cycle"])


@query(
    "L6_assembly",
    _FEATURE_SELECT.format(", transfer_cycle, partition_ AS partition, fee_eur") + "feats",
)
def l6(t):
    return ST.assemble(ST.bound_inputs(t)).select(
        *_feature_columns("transfer_cycle", "partition", "fee_eur")
    )


# --------------------------------------------------------------------- split and folds


@query(
    "F1_holdout_gates",
    """SELECT 'total_rows' AS gate, 200::BIGINT AS required, count(*) AS actual, count(*) >= 200 AS
    passed FROM feats UNION ALL SELECT 'test_rows', 40, count(*), count(*) >= 40 FROM test
    UNION ALL SELECT 'train_rows', 1, count(*), count(*) >= 1 FROM train
    UNION ALL SELECT 'repeated_keys', 0, count(*) - count(DISTINCT transfer_id),
    count(*) = count(DISTINCT transfer_id) FROM feats""",
)
def f1(t):
    return P.holdout_gates(ST.assemble(ST.bound_inputs(t)), "transfer_id", 200, 40)


@query(
    "F2_expanding_folds",
    """SELECT fold, transfer_id, CASE WHEN transfer_cycle < val THEN 'train' ELSE 'validation' END
    AS role FROM folds JOIN train ON transfer_cycle <= val""",
)
def f2(t):
    feats, _ = ST.landed_features(t)
    roles = P.fold_roles(feats.where("partition = 'train'"), B.N_FOLDS)
    return roles.select(big("fold"), "transfer_id", "role")


@query(
    "F2_fold_summary",
    """SELECT fold, val AS validation_cycle, (SELECT count(*) FROM train WHERE transfer_cycle < val) AS
    train_rows, (SELECT count(*) FROM train WHERE transfer_cycle = val) AS validation_rows,
    CAST((SELECT max(transfer_date) FROM train WHERE transfer_cycle < val) AS VARCHAR) AS train_last,
    CAST((SELECT min(transfer_date) FROM train WHERE transfer_cycle = val) AS VARCHAR)
      AS validation_first FROM folds""",
)
def f2_summary(t):
    feats, _ = ST.landed_features(t)
    out = P.fold_summary(feats.where("partition = 'train'"), B.N_FOLDS, 80, 20)
    return out.select(
        big("fold"), "validation_cycle", "train_rows", "validation_rows", txt("train_last"),
        txt("validation_first"),
    )


@query(
    "F3_split_summary",
    f"""SELECT partition_ AS partition, count(*) AS rows, count(DISTINCT player_id) AS unique_entities,
    CAST(min(transfer_date) AS VARCHAR) AS date_min, CAST(max(transfer_date) AS VARCHAR) AS date_max,
    array_to_string(list_sort(list(DISTINCT transfer_cycle)), ',') AS cycles,
    CAST(sum(position_is_proxy::INT) AS BIGINT) AS proxy_rows,
    {R('100 * avg(position_is_proxy::INT)', 4)} AS proxy_pct,
    (SELECT count(*) FROM (SELECT player_id FROM feats g WHERE g.partition_ = f.partition_
      GROUP BY player_id HAVING count(*) > 1)) AS repeat_entities,
    (SELECT count(*) FROM (SELECT player_id FROM train INTERSECT SELECT player_id FROM test))
      AS entities_on_both_sides FROM feats f GROUP BY partition_""",
)
def f3(t):
    feats, _ = ST.landed_features(t)
    out = P.split_summary(feats, "player_id", "transfer_date", "transfer_cycle", "position_is_proxy")
    return out.select(
        "partition", "rows", "unique_entities", txt("date_min"), txt("date_max"), "cycles",
        "proxy_rows", rnd("proxy_pct", 4), "repeat_entities", "entities_on_both_sides",
    )


# ---------------------------------------------------------- fitting and selecting models

_NUM = ["goals", "assists", "minutes", "age"]


@query(
    "M1_standardise",
    "SELECT fold, transfer_id, "
    + ", ".join(
        R(f"(v.{c} - avg_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END", 4) + f" AS z_{c}"
        for c in _NUM
    )
    + " FROM (SELECT fold, val, "
    + ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS sd_{c}" for c in _NUM)
    + " FROM folds JOIN train ON transfer_cycle < val GROUP BY fold, val) s"
    " JOIN train v ON v.transfer_cycle = s.val",
)
def m1(t):
    feats, _ = ST.landed_features(t)
    roles = P.fold_roles(feats.where("partition = 'train'"), B.N_FOLDS)
    moments = M.training_moments(roles.where("role = 'train'"), _NUM, ["fold"])
    out = M.standardise(roles.where("role = 'validation'"), moments, _NUM, "fold")
    return out.select(big("fold"), "transfer_id", *(rnd(f"z_{c}", 4) for c in _NUM))


@query(
    "M2_one_hot",
    "SELECT transfer_id, "
    + ", ".join(f"(coalesce(position = '{p}', FALSE))::INT::DOUBLE AS position_{p}" for p in S.POSITIONS)
    + " FROM candidates",
)
def m2(t):
    rows = M.with_one_hot(ST.candidates(ST.bound_inputs(t)), "position")
    return rows.select("transfer_id", *(f"position_{p}" for p in S.POSITIONS))


_ONE = {"minutes_only": ["minutes"]}
_ONE_STATS = """(SELECT {0} count(*) AS n, avg(minutes) AS mx, stddev_pop(minutes) AS sx,
    avg(fee_log1p) AS my, covar_pop(minutes, fee_log1p) AS cxy FROM {1} {2})"""
_GRID_SQL = "(VALUES " + ", ".join(
    f"({k}, '{c.name}', '{c.family}', {c.alpha}::DOUBLE, {c.l1_ratio}::DOUBLE)"
    for k, c in enumerate(M.linear_grid())
) + ") g(grid_order, candidate, family, alpha, l1)"
# One standardised input: each family has a closed form.
_W = """CASE family WHEN 'linear' THEN cxy / sx WHEN 'ridge' THEN (cxy / sx) / (1 + alpha / n)
    ELSE sign(cxy / sx) * greatest(abs(cxy / sx) - alpha * l1, 0) / (1 + alpha * (1 - l1)) END"""
_CV_SQL = f"""(SELECT grid_order, candidate, family, fold, count(*) AS rows,
    avg(abs(fee_log1p - (my + w * (minutes - mx) / sx))) AS log_mae FROM (
    SELECT *, {_W} AS w FROM {_ONE_STATS.format('fold, val,', 'folds JOIN train ON transfer_cycle < val',
    'GROUP BY fold, val')} CROSS JOIN {_GRID_SQL}) JOIN train ON transfer_cycle = val
    GROUP BY ALL)"""


def _train(t):
    feats, i = ST.landed_features(t)
    return feats.where("partition = 'train'"), feats.where("partition = 'test'"), i


@query(
    "M3_one_input_fits",
    f"""SELECT grid_order, candidate, {R(_W, 6)} AS coef, {R('my', 6)} AS intercept
    FROM {_ONE_STATS.format('', 'train', '')} CROSS JOIN {_GRID_SQL}""",
)
def m3(t):
    train, _, _ = _train(t)
    stats = M.grouped_moments(train, ["minutes"], "fee_log1p", "transfer_cycle")
    rows = []
    for k, c in enumerate(M.linear_grid()):
        f = M.final_fit(stats, c, ["minutes"], [], "fee_log1p")
        rows.append((k, c.name, float(f.coef[0]), f.intercept))
    out = t.spark.createDataFrame(rows, "grid_order int, candidate string, coef double, intercept double")
    return out.withColumn("coef", rnd("coef", 6)).withColumn("intercept", rnd("intercept", 6))


@query(
    "M4_cross_validation",
    f"SELECT grid_order, candidate, family, CAST(fold AS INT) AS fold, rows, {R('log_mae', 6)} AS log_mae FROM {_CV_SQL}",
)
def m4(t):
    train, _, _ = _train(t)
    scores, _, _ = M.cross_validate(train, _ONE, [], n_folds=B.N_FOLDS)
    return scores.select("grid_order", "candidate", "family", "fold", "rows", rnd("log_mae", 6))


_FLAGS = [f"position_{p}" for p in S.POSITIONS]
_HEADLINE = {"headline": list(M.NUMERIC)}


def _flagged(t):
    """Landed features with position columns: (train, test, all, study inputs)."""
    feats, i = ST.landed_features(t)
    feats = M.with_one_hot(feats, "position")
    return feats.where("partition = 'train'"), feats.where("partition = 'test'"), feats, i


@query(
    "M4_full_grid",
    f"""SELECT 'headline' AS variant, 0 AS variant_order, k AS grid_order, candidate, family, CAST(fold AS INT) AS fold, rows,
    {R('log_mae', 6)} AS log_mae, TRUE AS eligible FROM cv""",
)
def m4_full(t):
    train, *_ = _flagged(t)
    scores, _, _ = M.cross_validate(train, _HEADLINE, _FLAGS, n_folds=B.N_FOLDS)
    return scores.withColumn("log_mae", rnd("log_mae", 6))


@query(
    "M3_optimality",
    "SELECT candidate, CAST(f AS INT) AS fold, TRUE AS optimal FROM fits JOIN " + GRID + " USING (k) WHERE f >= 0",
)
def m3_optimality(t):
    train, *_ = _flagged(t)
    _, cv, _ = M.cross_validate(train, _HEADLINE, _FLAGS, n_folds=B.N_FOLDS)
    return M.optimality(train, cv, "fee_log1p", "transfer_cycle").select("candidate", "fold", (F.col("gap") < 1e-7).alias("optimal"))


@query(
    "M4_linear_and_ridge",
    f"""SELECT CASE WHEN alpha = 0 THEN 'linear' ELSE 'ridge(alpha=' || alpha || ')' END AS candidate, CAST(fold AS INT) AS fold,
    count(*) AS rows, {R('avg(abs(fee_log1p - ' + FIT + '))', 6)} AS log_mae FROM folds JOIN fits ON f = fold AND alpha IS NOT NULL
    JOIN design ON partition_ = 'train' AND transfer_cycle = val GROUP BY alpha, fold""",
)
def m4_linear(t):
    train, *_ = _flagged(t)
    grid = [c for c in M.linear_grid() if c.family != "elastic_net"]
    scores, _, _ = M.cross_validate(train, _HEADLINE, _FLAGS, n_folds=B.N_FOLDS, grid=grid)
    return scores.select("candidate", "fold", "rows", rnd("log_mae", 6))


_SUM_SQL = f"""(SELECT grid_order, candidate, family, round_even(avg(log_mae), 4) AS m,
    round_even(stddev_pop(log_mae), 4) AS s FROM {_CV_SQL} GROUP BY ALL)"""


@query(
    "M5_select_model",
    f"""SELECT family, candidate, grid_order, {R('m', 4)} AS mean_log_mae, {R('s', 4)} AS std_log_mae
    FROM {_SUM_SQL} QUALIFY row_number() OVER (PARTITION BY family ORDER BY m, s, grid_order) = 1
    UNION ALL (SELECT 'overall', candidate, grid_order, {R('m', 4)}, {R('s', 4)} FROM {_SUM_SQL}
    ORDER BY m, s, grid_order LIMIT 1)""",
)
def m5(t):
    train, _, _ = _train(t)
    scores, _, _ = M.cross_validate(train, _ONE, [], n_folds=B.N_FOLDS)
    cols = ["grid_order", "candidate", "family"]
    done = land(M.summarise_cv(scores, cols), "cv")
    keep = ["candidate", "grid_order", "mean_log_mae", "std_log_mae"]
    finalists = M.pick_best(done, [*keep, "family"], ["grid_order"], ["family"])
    overall = M.pick_best(done, keep, ["grid_order"]).withColumn("family", F.lit("overall"))
    out = finalists.unionByName(overall)
    return out.select(
        "family", "candidate", "grid_order",
        rnd(F.bround("mean_log_mae", 4), 4, "mean_log_mae"),
        rnd(F.bround("std_log_mae", 4), 4, "std_log_mae"),
    )


@query(
    "M5_full_grid",
    f"""SELECT family, candidate, k AS grid_order, {R('m', 4)} AS mean_log_mae, {R('s', 4)} AS std_log_mae, selected FROM finalists""",
)
def m5_full(t):
    train, *_ = _flagged(t)
    scores, _, _ = M.cross_validate(train, _HEADLINE, _FLAGS, n_folds=B.N_FOLDS)
    done = land(M.summarise_cv(scores, ["grid_order", "candidate", "family"]), "cv")
    keep = ["candidate", "grid_order", "mean_log_mae", "std_log_mae", "family"]
    best = M.pick_best(done, keep, ["grid_order"], ["family"])
    won = M.pick_best(done, ["grid_order"], ["grid_order"]).select("grid_order").scalar()
    return best.select(
        "family", "candidate", "grid_order", rnd(F.bround("mean_log_mae", 4), 4, "mean_log_mae"),
        rnd(F.bround("std_log_mae", 4), 4, "std_log_mae"), (F.col("grid_order") == won).alias("selected"))


def _coefficients() -> str:
    """OLS terms: per sd of a numeric input, and position columns that sum to zero (least norm)."""
    n, g = len(NUMBERS), len(GROUPS)
    level = "(" + " + ".join(f"w[{n + k}]" for k in range(1, g + 1)) + f") / {g}"
    one = " UNION ALL ".join(
        [f"SELECT '{c}' AS term, 'num' AS kind, w[{i}] * sd[{i}] AS c, m[{i}] AS mean, sd[{i}] AS s FROM fits WHERE f = -1 AND alpha = 0"
         for i, c in enumerate(NUMBERS, 1)]
        + [f"SELECT 'position_{c}', 'cat', w[{n + k}] - {level}, NULL, NULL FROM fits WHERE f = -1 AND alpha = 0" for k, c in enumerate(GROUPS, 1)]
        + [f"SELECT '(intercept)', 'intercept', my - ({' + '.join(f'(w[{n + k}] - {level}) * m[{n + k}]' for k in range(1, g + 1))}), NULL, NULL "
           "FROM fits WHERE f = -1 AND alpha = 0"])
    return (f"SELECT term, kind, {R('c', 6)} AS coef_log1p, {R('exp(c)', 4)} AS multiplier_on_1p_fee, {R('mean', 6)} AS train_mean, "
            f"{R('s', 6)} AS train_sd FROM ({one})")


@query("M6_coefficient_table", _coefficients())
def m6(t):
    train, *_ = _flagged(t)
    stats = M.grouped_moments(train, [*M.NUMERIC, *_FLAGS], "fee_log1p", "transfer_cycle")
    fit = M.final_fit(stats, M.linear_grid()[0], M.NUMERIC, _FLAGS, "fee_log1p")
    return M.coefficient_table(train, fit, M.NUMERIC).select(
        "term", "kind", rnd("coef_log1p", 6), rnd("multiplier_on_1p_fee", 4), rnd("train_mean", 6), rnd("train_sd", 6))


@query(
    "M6_training_moments",
    " UNION ALL ".join(
        f"SELECT '{c}' AS term, count(*) AS rows, {R(f'avg({c})', 6)} AS train_mean, "
        f"{R(f'stddev_pop({c})', 6)} AS train_sd, stddev_pop({c}) = 0 AS constant FROM train"
        for c in M.NUMERIC
    ),
)
def m6_moments(t):
    train, _, _ = _train(t)
    return M.training_moments(train, M.NUMERIC).select(
        "term", "rows", rnd("train_mean", 6), rnd("train_sd", 6), "constant"
    )


@query("M7_variant_selection")
def m7(t):
    train = ST.landed_enriched(t).where("partition = 'train'")
    first = M.variants()
    every = {**first, **M.context_variants(first)}
    scores, _, _ = M.cross_validate(train, every, list(M.one_hot("position")), n_folds=B.N_FOLDS)
    cols = ["variant", "variant_order", "grid_order", "candidate", "family"]
    done = land(M.summarise_cv(scores, cols), "cv")
    keep = ["variant_order", "candidate", "grid_order", "mean_log_mae", "std_log_mae"]
    best = M.pick_best(done, [*keep, "variant"], ["grid_order"], ["variant"])
    stage = F.when(F.col("variant").endswith("+context"), "enriched").otherwise("followup")
    staged = best.withColumn("eligible", F.lit(True)).withColumn("stage", stage)
    picked = M.pick_best(staged, ["variant"], ["variant_order", "grid_order"], ["stage"])
    hit = picked.select("variant", F.lit(True).alias("_hit"))
    return best.join(F.broadcast(hit), "variant", "left").select(
        "variant", *keep, F.coalesce("_hit", F.lit(False)).alias("selected")
    )


_TWO = {"minutes": ["minutes"], "goals": ["goals"]}


def _one_ols(x: str) -> str:
    return f"""SELECT '{x}' AS variant, fold, avg(abs(fee_log1p - (a + b * {x}))) AS log_mae FROM (
    SELECT fold, val, regr_slope(fee_log1p, {x}) AS b, regr_intercept(fee_log1p, {x}) AS a
    FROM folds JOIN train ON transfer_cycle < val GROUP BY fold, val)
    JOIN train ON transfer_cycle = val GROUP BY fold"""


@query(
    "M7_pick_variant",
    f"""SELECT variant, {R('m', 4)} AS mean_log_mae, row_number() OVER (ORDER BY m, s, o) = 1 AS selected
    FROM (SELECT variant, round_even(avg(log_mae), 4) AS m, round_even(stddev_pop(log_mae), 4) AS s,
    CASE variant WHEN 'minutes' THEN 0 ELSE 1 END AS o
    FROM ({_one_ols('minutes')} UNION ALL {_one_ols('goals')}) GROUP BY variant)""",
)
def m7_pick(t):
    train, _, _ = _train(t)
    scores, _, _ = M.cross_validate(train, _TWO, [], n_folds=B.N_FOLDS, grid=[M.Candidate("linear")])
    done = land(M.summarise_cv(scores, ["variant", "variant_order", "grid_order"]), "cv")
    win = M.pick_best(done, ["variant"], ["variant_order", "grid_order"])
    return done.join(
        F.broadcast(win.withColumn("_hit", F.lit(True))), "variant", "left"
    ).select(
        "variant", rnd(F.bround("mean_log_mae", 4), 4, "mean_log_mae"),
        F.coalesce("_hit", F.lit(False)).alias("selected"),
    )


@query("M8_ablation")
def m8(t):
    full = ST.landed_enriched(t)
    base = M.context_variants(M.variants())["exposure+price_level+context"]
    groups = {"full": base, **M.ablations(base)}
    scores, _, _ = M.cross_validate(
        full.where("partition = 'train'"), groups, list(M.one_hot("position")), n_folds=B.N_FOLDS
    )
    done = M.summarise_cv(scores, ["variant", "variant_order", "grid_order", "candidate"])
    return M.pick_best(
        done, ["candidate", "grid_order", "mean_log_mae", "std_log_mae", "variant"], ["grid_order"], ["variant"]
    )


_BOOSTED = [*M.NUMERIC, *_FLAGS]


def _boosted_train(t):
    return M.with_one_hot(ST.landed_model(t), "position").where("partition = 'train'")


@query("M9_boosted_trees")
def m9(t):
    train = _boosted_train(t)
    scores = GB.cross_validate(train, _BOOSTED, "fee_log1p", "transfer_cycle", B.N_FOLDS)
    keys = ["grid_order", "candidate"]
    best = M.pick_best(M.summarise_cv(scores, keys), keys, ["grid_order"]).select("grid_order", F.lit(True).alias("_hit"))
    return scores.join(F.broadcast(best), "grid_order", "left").withColumn("selected", F.coalesce("_hit", F.lit(False))).drop("_hit")


@query("M10_monotonicity_audit")
def m10(t):
    train = _boosted_train(t)
    rows = land(GB.assembled(train, _BOOSTED, "fee_log1p"), "boosting-rows")
    path = f"{shared_folder(t.spark)}/trees-{uuid.uuid4().hex}"
    GB.fit(rows, max(GB.DEPTHS), min(GB.LEAVES), max(GB.ROUNDS)).write().save(path)
    return GB.monotonicity_audit(rows, GB.ensemble(t.spark, path), _BOOSTED)


# ------------------------------------------------------- evaluation, resampling, intervals


def _models(t):
    """Grid scored, each family's best and the winner fitted on all training rows.

    (train, test, all rows, study inputs, folds of the winner, winning family, log prediction per family)
    """
    train, test, feats, i = _flagged(t)
    scores, cv, stats = M.cross_validate(train, _HEADLINE, _FLAGS, n_folds=B.N_FOLDS)
    pick, grid = M.select_models(scores), M.linear_grid()
    logs = {f: M.prediction(M.final_fit(stats, grid[k], M.NUMERIC, _FLAGS, "fee_log1p")) for f, k in pick.finalists.items()}
    return train, test, feats, i, cv.only("headline", pick.grid_order), pick.selected, logs


def _fitted(t):
    """Test rows with the predictions of the selected model, of each family's best and of the baselines.

    (those rows, training rows, folds of the selected model, study inputs, its log prediction)
    """
    train, test, _, i, cv, selected, logs = _models(t)
    scored = E.with_baselines(test, train, "fee_eur", "position")
    scored = scored.withColumns({f"log__{f}": logs[f] for f in M.FAMILIES}).withColumns({f: S.back_to_units(f"log__{f}") for f in M.FAMILIES})
    scored = scored.withColumns({"selected_family": F.lit(selected), "prediction_log": F.col(f"log__{selected}"), "prediction": F.col(selected)})
    scored = scored.withColumn("residual", F.col("fee_eur") - F.col("prediction")).withColumn("abs_error", F.abs("residual"))
    return land(scored, "scored"), train, cv, i, logs[selected]


def _methods() -> dict[str, tuple[Column, Column]]:
    base = {m: (F.col(m), F.log1p(F.col(m))) for m in E.BASELINES}
    return {**{f: (F.col(f), F.col(f"log__{f}")) for f in M.FAMILIES}, **base}


_PREDICTED = {**{f: (f"p_{f}", f"g_{f}") for f in M.FAMILIES}, "train_median": ("p_median", "ln(1 + p_median)"),
              "train_mean": ("p_mean", "ln(1 + p_mean)"), "train_median_by_position": ("p_pos", "ln(1 + p_pos)")}
_LONG = "(SELECT transfer_id, player_id, fee_eur AS y, fee_log1p AS yl, unnest([" + ", ".join(
    f"{{'m': '{m}', 'p': {p}, 'g': {g}}}" for m, (p, g) in _PREDICTED.items()) + "], recursive := true) FROM scored)"


@query(
    "M11_score_models",
    f"SELECT transfer_id, {R('pred_log', 6)} AS prediction_log, {R('greatest(exp(pred_log) - 1, 0)', 2)} AS prediction, "
    f"{R('fee_log1p - pred_log', 6)} AS log_residual FROM predicted",
)
def m11(t):
    _, _, feats, _, _, selected, logs = _models(t)
    return feats.withColumn("prediction_log", logs[selected]).select(
        "transfer_id", rnd("prediction_log", 6), rnd(S.back_to_units("prediction_log"), 2, "prediction"),
        rnd(F.col("fee_log1p") - F.col("prediction_log"), 6, "log_residual"),
    )


@query(
    "E1_baselines",
    f"SELECT transfer_id, {R('p_median', 4)} AS train_median, {R('p_mean', 4)} AS train_mean, "
    f"{R('p_pos', 4)} AS train_median_by_position, fallback AS group_fallback FROM scored",
)
def e1(t):
    train, test, _ = _train(t)
    out = E.with_baselines(test, train, "fee_eur", "position")
    return out.select("transfer_id", *(rnd(m, 4) for m in E.BASELINES), "group_fallback")


@query(
    "E2_metrics",
    f"""SELECT m AS method, {R('avg(abs(y - p))', 3)} AS mae, {R('quantile_cont(abs(y - p), 0.5)', 3)} AS
    median_ae, {R('sqrt(avg((y - p) * (y - p)))', 3)} AS rmse, {R('avg(abs(yl - g))', 6)} AS log_mae,
    {R('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 6)} AS r2, count(*) AS rows,
    m IN (SELECT family FROM finalists WHERE selected) AS selected FROM {_LONG} GROUP BY m""",
)
def e2(t):
    scored, *_ = _fitted(t)
    out = E.metrics(E.long_errors(scored, ["transfer_id", "selected_family"], "fee_eur", _methods()), ["method", "selected_family"])
    return out.select(
        "method", rnd("mae", 3), rnd("median_ae", 3), rnd("rmse", 3), rnd("log_mae", 6), rnd("r2", 6),
        "rows", (F.col("method") == F.col("selected_family")).alias("selected"),
    )


_REPS, _SEED = 5000, 42


def _hash_sql(rows: str, place: str, seed: int) -> str:
    """Rows with h, the 32-bit hash of (rep, place, seed), step by step."""
    def mixed(body: str, x: str, out: str) -> str:
        body = f"SELECT *, {x} AS {out}_0 FROM ({body})"
        for k in range(2):
            body = f"SELECT *, (xor({out}_{k} >> 16, {out}_{k}) * {E.MIX}) & {E.LOW32} AS {out}_{k + 1} FROM ({body})"
        return f"SELECT *, xor({out}_2 >> 16, {out}_2) AS {out} FROM ({body})"

    own = mixed(rows, f"((rep + {seed * 65537}) & {E.LOW32})::BIGINT", "r")
    return mixed(own, f"xor(r, (({place} + ({place} >> 32) * {E.MIX}) & {E.LOW32})::BIGINT)", "h")


def _boot_oracle(methods: dict[str, str], reference: str, rows: str) -> str:
    """Thinned Poisson counts over clusters numbered in (md5, key) order, then the missing draws one by one."""
    sums = ", ".join(f"sum(abs(fee_eur - {p})) AS e_{m}" for m, p in methods.items())
    others = [m for m in methods if m != reference]
    mean = f"greatest(0, 1 - {E.MARGIN!r} / sqrt(clusters))"
    step = f"floor(4294967296 * list_sum(list_transform(range(0, k + 1), lambda j: exp(-lam) * pow(lam, j) / factorial(CAST(j AS INTEGER)))))"
    weight = "list_sum(list_transform(steps, lambda c: (h >= c)::INT))"
    every = ["n", *(f"e_{m}" for m in methods)]
    counted = ", ".join(f"sum({weight} * {c}) AS {c}" for c in every)
    return f"""SELECT * FROM (WITH idx AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY md5(CAST(player_id AS VARCHAR)), player_id) - 1)::BIGINT AS i,
      count(*) OVER ()::BIGINT AS clusters FROM (SELECT player_id, count(*) AS n, {sums} FROM {rows} GROUP BY player_id)),
    st AS MATERIALIZED (SELECT clusters, list_transform(range(0, 17), lambda k: {step}) AS steps FROM (SELECT clusters, {mean} AS lam FROM idx LIMIT 1)),
    cnt AS MATERIALIZED (SELECT rep, sum({weight})::BIGINT AS draws, {counted}
      FROM ({_hash_sql(f"SELECT x.rep::BIGINT AS rep, idx.*, steps FROM range({_REPS}) x(rep) CROSS JOIN idx CROSS JOIN st", "i", _SEED)}) GROUP BY rep),
    one AS (SELECT rep, {', '.join(f'sum({c}) AS {c}' for c in every)} FROM (SELECT rep, ((h * total) >> 32)::BIGINT AS s
        FROM ({_hash_sql("SELECT rep, total, unnest(range(1, total - draws + 1))::BIGINT AS j FROM (SELECT rep, draws, (SELECT clusters FROM st) AS total FROM cnt)", "j", _SEED + 1)})) JOIN idx ON i = s GROUP BY rep),
    reps AS (SELECT rep, {', '.join(f'sum({c}) AS {c}' for c in every)} FROM (SELECT rep, {', '.join(every)} FROM cnt UNION ALL SELECT rep, {', '.join(every)} FROM one) GROUP BY rep)
    """ + " UNION ALL ".join(
        f"""SELECT '{m}' AS comparison, {R('o', 3)} AS observed_delta, {R('lo', 3)} AS ci_low, {R('hi', 3)} AS ci_high,
    CASE WHEN hi < 0 THEN 'lower' WHEN lo > 0 THEN 'higher' ELSE 'unclear' END AS verdict, clusters FROM (
      SELECT quantile_cont((e_{reference} - e_{m}) / n, 0.025) AS lo, quantile_cont((e_{reference} - e_{m}) / n, 0.975) AS hi FROM reps) CROSS JOIN (
      SELECT (sum(e_{reference}) - sum(e_{m})) / sum(n) AS o, count(*) AS clusters FROM idx)"""
        for m in others
    ) + ")"


@query(
    "E3_cluster_bootstrap",
    _boot_oracle(
        {"selected": "pred", "train_median": "p_median", "train_mean": "p_mean", "train_median_by_position": "p_pos"}, "selected", "scored",
    ),
)
def e3(t, weights="multinomial"):
    scored, *_ = _fitted(t)
    errors = {m: F.abs(F.col("fee_eur") - F.col(p)) for m, p in {"selected": "prediction", **{m: m for m in E.BASELINES}}.items()}
    out = E.paired_cluster_bootstrap(scored, "player_id", errors, "selected", _REPS, _SEED, 0.95, weights)
    return out.select(
        "comparison", rnd("observed_delta", 3), rnd("ci_low", 3), rnd("ci_high", 3), "verdict", "clusters"
    )


_POISSON = " + ".join(f"(u >= {c!r})::INT" for c in E.poisson_steps())
_ERRORS = {"selected": "pred", "train_median": "p_median", "train_mean": "p_mean", "train_median_by_position": "p_pos"}
_SUMS = ", ".join(f"sum(abs(fee_eur - {p})) AS e_{m}" for m, p in _ERRORS.items())


@query(
    "E3_poisson_bootstrap",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS comparison, {R('o', 3)} AS observed_delta, {R('lo', 3)} AS ci_low, {R('hi', 3)} AS ci_high,
    CASE WHEN hi < 0 THEN 'lower' WHEN lo > 0 THEN 'higher' ELSE 'unclear' END AS verdict, clusters FROM (
    SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM (
      SELECT sum(w * (e_selected - e_{m})) / sum(w * n) AS d FROM (SELECT *, {_POISSON} AS w FROM (
        SELECT rep, c.*, ('0x' || substr(md5(rep || '|' || player_id || '|{_SEED}'), 1, 13))::BIGINT / {float(16**13)!r} AS u
        FROM range({_REPS}) r(rep) CROSS JOIN (SELECT player_id, count(*) AS n, {_SUMS} FROM scored GROUP BY player_id) c))
      GROUP BY rep HAVING sum(w) > 0)) CROSS JOIN (
    SELECT (sum(e_selected) - sum(e_{m})) / sum(n) AS o, count(*) AS clusters FROM (
      SELECT player_id, count(*) AS n, {_SUMS} FROM scored GROUP BY player_id))"""
        for m in list(_ERRORS)[1:]),
)
def e3_poisson(t):
    return e3(t, "poisson")


@query(
    "E4_worst_misses",
    f"SELECT transfer_id, {R('abs_error', 2)} AS abs_error FROM scored ORDER BY scored.abs_error DESC, transfer_id LIMIT 5",
)
def e4(t):
    scored, *_ = _fitted(t)
    return E.worst_k(scored, "abs_error", "transfer_id", 5).select("transfer_id", rnd("abs_error", 2))


@query(
    "E5_residual_overview",
    f"""SELECT {R('avg((residual > 0)::INT)', 6)} AS share_underpredicted, {R('avg(residual)', 3)} AS
    mean_residual, {R('quantile_cont(residual, 0.5)', 3)} AS median_residual, {R('avg(log_res)', 6)} AS
    mean_log_residual FROM scored""",
)
def e5(t):
    scored, *_ = _fitted(t)
    return E.residual_overview(scored, "fee_eur").select(
        rnd("share_underpredicted", 6), rnd("mean_residual", 3), rnd("median_residual", 3),
        rnd("mean_log_residual", 6),
    )


@query(
    "E5_residuals_by_position",
    f"""SELECT position, count(*) AS rows, {R('avg(abs_error)', 3)} AS mae,
    {R('quantile_cont(residual, 0.5)', 3)} AS median_residual FROM scored GROUP BY 1""",
)
def e5_groups(t):
    scored, *_ = _fitted(t)
    return E.residuals_by_group(scored, "position").select(
        "position", "rows", rnd("mae", 3), rnd("median_residual", 3)
    )


@query(
    "E6_prediction_table",
    f"""SELECT transfer_id, position, minutes, fee_eur, {', '.join(f"{R(p, 2)} AS pred__{m}" for m, (p, _) in _PREDICTED.items())}, {R('residual', 2)} AS residual,
    {R('abs_error', 2)} AS abs_error FROM scored""",
)
def e6(t):
    scored, *_ = _fitted(t)
    keep = ["transfer_id", "position", "minutes", "fee_eur"]
    methods = {**_methods(), "selected": (F.col("prediction"), F.col("prediction_log"))}
    out = E.prediction_table(scored, keep, "fee_eur", methods, "selected")
    cols = [f"pred__{m}" for m in _methods()]
    return out.select(*keep, *(rnd(c, 2) for c in [*cols, "residual", "abs_error"]))


@query(
    "E7_window_diagnostic",
    f"""SELECT e.window_ AS window, count(*) AS rows, {R('avg(e.minutes)', 4)} AS mean_raw_minutes,
    {R('avg(e.equivalents)', 6)} AS mean_season_equivalents, {R('avg(e.minutes_share)', 6)} AS
    mean_minutes_share, {R('avg(log_res)', 6)} AS mean_log_residual, {R('avg(abs_error)', 3)} AS mae
    FROM exposed e JOIN scored s ON e.transfer_id = s.transfer_id GROUP BY 1""",
)
def e7(t):
    scored, _, _, i, _ = _fitted(t)
    rows = A.exposure_columns(scored, i.games, i.appearances, i.expected)
    out = E.group_means(
        rows, ["window"],
        {"mean_raw_minutes": F.col("minutes"),
         "mean_season_equivalents": F.col("lookback_season_equivalents"),
         "mean_minutes_share": F.col("minutes_share"),
         "mean_log_residual": F.col("fee_log1p") - F.col("prediction_log"), "mae": F.col("abs_error")},
    )
    return out.select(
        "window", "rows", rnd("mean_raw_minutes", 4), rnd("mean_season_equivalents", 6),
        rnd("mean_minutes_share", 6), rnd("mean_log_residual", 6), rnd("mae", 3),
    )


_MV = f"({asof_sql('scored')})"


def _valued(t):
    scored, _, _, _, _ = _fitted(t)
    return land(
        A.asof_latest_by_day(
            scored, B.clean_values(t), "player_id", "transfer_date", "valuation_date",
            "market_value_eur", B.STALE_DAYS,
        ),
        "valued",
    )


@query(
    "E8_comparator_status",
    f"""SELECT status AS market_value_status, count(*) AS rows, (SELECT {R('quantile_cont(age_days, 0.5)', 2)}
    FROM {_MV} WHERE status = 'matched') AS median_age, (SELECT {R('avg((fee_eur > market_value_eur)::INT)', 6)}
    FROM {_MV} WHERE status = 'matched') AS share_label_above FROM {_MV} GROUP BY 1""",
)
def e8(t):
    return E.status_overview(_valued(t), "fee_eur").select(
        "market_value_status", "rows", rnd("median_age", 2), rnd("share_label_above", 6)
    )


@query(
    "E8_comparator_metrics",
    f"""SELECT m AS method, {R('avg(abs(fee_eur - p))', 3)} AS mae, {R('quantile_cont(abs(fee_eur - p), 0.5)', 3)}
    AS median_ae, {R('avg(abs(fee_log1p - ln(1 + p)))', 6)} AS log_mae, count(*) AS rows FROM (
    SELECT fee_eur, fee_log1p, unnest([{{'m': 'selected', 'p': pred}}, {{'m': 'market_value', 'p': market_value_eur}},
    {{'m': 'train_median', 'p': p_median}}], recursive := true) FROM {_MV} WHERE status = 'matched') GROUP BY 1""",
)
def e8_metrics(t):
    rows = _valued(t).where("market_value_status = 'matched'")
    methods = {
        "selected": (F.col("prediction"), F.log1p("prediction")),
        "market_value": (F.col("market_value_eur"), F.log1p("market_value_eur")),
        "train_median": (F.col("train_median"), F.log1p("train_median")),
    }
    out = E.metrics(E.long_errors(rows, ["transfer_id"], "fee_eur", methods))
    return out.select("method", rnd("mae", 3), rnd("median_ae", 3), rnd("log_mae", 6), "rows")


@query(
    "E8_comparator_bootstrap",
    _boot_oracle(
        {"selected": "pred", "market_value": "market_value_eur"}, "selected", f"(SELECT * FROM {_MV} WHERE status = 'matched')",
    ),
)
def e8_boot(t):
    rows = _valued(t).where("market_value_status = 'matched'")
    errors = {c: F.abs(F.col("fee_eur") - F.col(p)) for c, p in
              (("selected", "prediction"), ("market_value", "market_value_eur"))}
    out = E.paired_cluster_bootstrap(
        rows, "player_id", errors, "selected", _REPS, _SEED, 0.95
    )
    return out.select(
        "comparison", rnd("observed_delta", 3), rnd("ci_low", 3), rnd("ci_high", 3), "verdict", "clusters"
    )


@query(
    "E9_context_share",
    f"""SELECT partition_ AS partition, {R('avg((europe_minutes > 0)::INT)', 6)} AS share_europe_minutes,
    {R('avg((other_league_minutes > 0)::INT)', 6)} AS share_other_league_minutes
    FROM feats JOIN ctx USING (transfer_id) GROUP BY 1""",
)
def e9(t):
    out = E.share_positive(_context(t), "partition", ["europe_minutes", "other_league_minutes"])
    return out.select("partition", rnd("share_europe_minutes", 6), rnd("share_other_league_minutes", 6))


@query(
    "E10_price_level_by_cycle",
    f"""SELECT transfer_cycle, {R('exp(quantile_cont(league_price_level, 0.5))', 2)} AS median_level
    FROM feats JOIN level USING (transfer_date) GROUP BY 1""",
)
def e10(t):
    feats, i = ST.landed_features(t)
    level = ST.landed_price_level(feats, i, 1)
    rows = land(
        feats.select("transfer_cycle", "transfer_date").join(F.broadcast(level), "transfer_date"), "levels"
    )
    return E.median_level_by_cycle(rows, "transfer_cycle", "league_price_level").select(
        "transfer_cycle", rnd("median_level", 2)
    )


@query("E11_oof_residuals", f"SELECT transfer_id, CAST(fold AS INT) AS fold, {R('r', 6)} AS residual FROM oof")
def e11(t):
    _, train, cv, _, _ = _fitted(t)
    out = CF.out_of_fold(train, cv, "headline", 0, "transfer_cycle", "fee_log1p")
    return out.select("transfer_id", "fold", rnd("oof_residual", 6, "residual"))


_LEVELS = (0.8, 0.9)


def _q_sql(level: float) -> str:
    return f"""SELECT {level}::DOUBLE AS level, count(*) AS calibration_rows, (SELECT r FROM (
    SELECT abs(r) AS r, row_number() OVER (ORDER BY abs(r)) AS i FROM oof)
    WHERE i = (SELECT CAST(ceil((count(*) + 1)::DOUBLE * {level}::DOUBLE) AS BIGINT) FROM oof)) AS q_log
    FROM oof"""


_QS = "(" + " UNION ALL ".join(_q_sql(x) for x in _LEVELS) + ")"


def _quantiles(train, cv):
    oof = CF.out_of_fold(train, cv, "headline", 0, "transfer_cycle", "fee_log1p").withColumn(
        "score", F.abs("oof_residual")
    )
    return land(CF.conformal_quantile(oof, "score", _LEVELS), "quantiles")


@query("E12_conformal_quantile", f"SELECT level, calibration_rows, {R('q_log', 6)} AS q_log FROM {_QS}")
def e12(t):
    _, train, cv, _, _ = _fitted(t)
    return _quantiles(train, cv).select("level", "calibration_rows", rnd("q_log", 6))


@query(
    "E13_intervals",
    f"""SELECT transfer_id, level, {R('greatest(exp(pred_log - q_log) - 1, 0)', 2)} AS lower,
    {R('exp(pred_log + q_log) - 1', 2)} AS upper FROM scored CROSS JOIN {_QS}""",
)
def e13(t):
    scored, train, cv, _, _ = _fitted(t)
    rows = CF.with_levels(scored, _quantiles(train, cv))
    lo, hi = CF.interval(F.col("prediction_log"), F.col("q_log"))
    return rows.select("transfer_id", "level", rnd(lo, 2, "lower"), rnd(hi, 2, "upper"))


_COV = ", ".join(
    f"{R(f'avg(({c})::INT)', 6)} AS {n}"
    for c, n in (("abs(log_res) <= q_log", "coverage"), ("log_res > q_log", "share_above_upper"),
                 ("log_res < -q_log", "share_below_lower"))
)


@query(
    "E14_coverage",
    f"""SELECT level, 'all' AS item, 'all' AS value, count(*) AS rows, {_COV} FROM scored CROSS JOIN {_QS}
    GROUP BY level UNION ALL SELECT level, 'transfer_cycle', CAST(transfer_cycle AS VARCHAR), count(*), {_COV}
    FROM scored CROSS JOIN {_QS} GROUP BY level, transfer_cycle UNION ALL SELECT level, 'position', position,
    count(*), {_COV} FROM scored CROSS JOIN {_QS} GROUP BY level, position""",
)
def e14(t):
    scored, train, cv, _, _ = _fitted(t)
    out = CF.coverage_report(
        scored, _quantiles(train, cv), "fee_eur", "prediction_log", ["transfer_cycle", "position"]
    )
    return out.select(
        "level", "item", "value", "rows",
        *(rnd(c, 6) for c in ("coverage", "share_above_upper", "share_below_lower")),
    )


@query(
    "E14_interval_medians",
    f"""SELECT level, calibration_rows, {R('q_log', 6)} AS q_log, {R('exp(q_log)', 6)} AS factor,
    {R('quantile_cont(exp(pred_log) - 1, 0.5)', 2)} AS median_prediction,
    {R('quantile_cont(greatest(exp(pred_log - q_log) - 1, 0), 0.5)', 2)} AS median_lower,
    {R('quantile_cont(exp(pred_log + q_log) - 1, 0.5)', 2)} AS median_upper
    FROM scored CROSS JOIN {_QS} GROUP BY level, calibration_rows, q_log""",
)
def e14_medians(t):
    scored, train, cv, _, _ = _fitted(t)
    out = CF.interval_medians(scored, _quantiles(train, cv), "prediction_log")
    return out.select(
        "level", "calibration_rows", rnd("q_log", 6), rnd("factor", 6),
        *(rnd(c, 2) for c in ("median_prediction", "median_lower", "median_upper")),
    )


@query(
    "E15_compression",
    f"""SELECT {R('exp(max(pred_log)) - 1', 2)} AS max_prediction, max(fee_eur) AS largest_label,
    {R('(SELECT exp(pred_log) - 1 FROM scored ORDER BY fee_eur DESC, transfer_id LIMIT 1)', 2)}
      AS prediction_for_largest,
    count(*) FILTER (fee_log1p >= c) AS top_decile_rows,
    {R('avg(log_res) FILTER (fee_log1p >= c)', 6)} AS top_decile_mean_log_residual,
    {R('regr_slope(fee_log1p, pred_log)', 3)} AS calibration_slope
    FROM scored CROSS JOIN (SELECT quantile_cont(fee_log1p, 0.9) AS c FROM scored)""",
)
def e15(t):
    scored, *_ = _fitted(t)
    out = CF.compression(scored, "fee_eur", "prediction_log", "transfer_id")
    return out.select(
        rnd("max_prediction", 2), "largest_label", rnd("prediction_for_largest", 2), "top_decile_rows",
        rnd("top_decile_mean_log_residual", 6), rnd("calibration_slope", 3),
    )


def _bands(k: int) -> str:
    # Ties follow the first 13 hex digits of the key's md5, as on the Spark side.
    return f"""(SELECT *, ntile({k}) OVER (ORDER BY pred, substr(md5(transfer_id), 1, 13)) AS band
    FROM scored)"""


@query(
    "E16_residual_bands",
    f"""SELECT CAST(band AS INT) AS band, count(*) AS rows, {R('min(pred)', 2)} AS predicted_min,
    {R('max(pred)', 2)} AS predicted_max, {R('quantile_cont(log_res, 0.5)', 6)} AS median_log_residual,
    {R('quantile_cont(log_res, 0.75) - quantile_cont(log_res, 0.25)', 6)} AS iqr_log
    FROM {_bands(6)} GROUP BY band""",
)
def e16(t):
    scored, *_ = _fitted(t)
    return FX.residual_bands(scored, "fee_eur", "transfer_id").select(
        "band", "rows", rnd("predicted_min", 2), rnd("predicted_max", 2), rnd("median_log_residual", 6),
        rnd("iqr_log", 6),
    )


@query(
    "E16_coverage_quarters",
    f"""SELECT CAST(band AS INT) AS band, count(*) AS rows, {R('min(pred)', 2)} AS predicted_min,
    {R('max(pred)', 2)} AS predicted_max, {R('avg((abs(log_res) <= q)::INT)', 6)} AS coverage,
    {R('avg((log_res > q)::INT)', 6)} AS share_above_upper, {R('avg((log_res < -q)::INT)', 6)} AS
    share_below_lower FROM {_bands(4)} CROSS JOIN q80 GROUP BY band""",
)
def e16_quarters(t):
    scored, train, cv, _, _ = _fitted(t)
    q = _quantiles(train, cv).where("level = 0.8").select("q_log").scalar()
    out = FX.coverage_quarters(scored, "fee_eur", "transfer_id", q)
    return out.select(
        "band", "rows", rnd("predicted_min", 2), rnd("predicted_max", 2),
        *(rnd(c, 6) for c in ("coverage", "share_above_upper", "share_below_lower")),
    )


@query(
    "E17_worst_with_flags",
    f"""SELECT transfer_id, position, fee_eur, {R('pred', 2)} AS prediction, {R('log_res', 6)} AS
    log_residual, log_res > q AS above_upper FROM scored CROSS JOIN q80
    ORDER BY abs_error DESC, transfer_id LIMIT 5""",
)
def e17(t):
    scored, train, cv, _, _ = _fitted(t)
    q = _quantiles(train, cv).where("level = 0.8").select("q_log").scalar()
    out = FX.worst_with_flags(scored, "fee_eur", "transfer_id", q, 5, ["position"])
    return out.select(
        "transfer_id", "position", "fee_eur", rnd("prediction", 2), rnd("log_residual", 6), "above_upper"
    )


@query(
    "E18_largest_labels",
    f"""SELECT transfer_id, fee_eur, {R('lo', 2)} AS lower, {R('hi', 2)} AS upper,
    fee_eur >= lo AND fee_eur <= hi AS covered, fee_eur > pred AS above_prediction,
    transfer_id IN (SELECT transfer_id FROM scored ORDER BY abs_error DESC, transfer_id LIMIT 5) AS in_worst
    FROM (SELECT *, greatest(exp(pred_log - q) - 1, 0) AS lo, exp(pred_log + q) - 1 AS hi
    FROM scored CROSS JOIN q80) ORDER BY fee_eur DESC, transfer_id LIMIT 25""",
)
def e18(t):
    scored, train, cv, _, _ = _fitted(t)
    q = _quantiles(train, cv).where("level = 0.8").select("q_log").scalar()
    lo, hi = CF.interval(F.col("prediction_log"), F.col("_q"))
    bounds = scored.withColumn("_q", q).select("transfer_id", lo.alias("lower"), hi.alias("upper"))
    out = FX.largest_labels(scored, bounds, "fee_eur", "transfer_id")
    return out.select(
        "transfer_id", "fee_eur", rnd("lower", 2), rnd("upper", 2), "covered", "above_prediction", "in_worst"
    )


@query(
    "E19_drift_by_cycle",
    f"""SELECT transfer_cycle, partition_ AS partition, count(*) AS rows,
    {R('avg(fee_log1p - pred_log)', 6)} AS mean_log_residual,
    {R('quantile_cont(fee_eur, 0.5)', 3)} AS median_label FROM predicted GROUP BY ALL""",
)
def e19(t):
    _, _, feats, _, _, selected, logs = _models(t)
    out = E.drift_by_cycle(feats, "transfer_cycle", "fee_eur", F.col("fee_log1p") - logs[selected])
    return out.select(
        "transfer_cycle", "partition", "rows", rnd("mean_log_residual", 6), rnd("median_label", 3)
    )


@query(
    "E20_compare_worst",
    f"""SELECT s.transfer_id, {', '.join(f"{R(f'p_{m}', 2)} AS pred__{m}" for m in M.FAMILIES)}, {R('p_median', 2)} AS pred__train_median,
    {R('p_pos', 2)} AS pred__by_position, europe_minutes, other_league_minutes,
    fee_eur >= greatest(exp(pred_log - q) - 1, 0) AND fee_eur <= exp(pred_log + q) - 1 AS covered
    FROM scored s JOIN ctx USING (transfer_id) CROSS JOIN q80 ORDER BY abs_error DESC, s.transfer_id LIMIT 5""",
)
def e20(t):
    scored, train, cv, i, _ = _fitted(t)
    q = _quantiles(train, cv).where("level = 0.8").select("q_log").scalar()
    worst = land(E.worst_k(scored, "abs_error", "transfer_id", 5), "worst")
    comps = B.competitions(t)
    others = A.other_leagues(comps, comps.where("in_study").select("competition_id"))
    everything = B.appearance_rows(t, B.all_games(t))
    ctx = A.context_columns(
        worst, i.seasons, A.with_points(i.appearances, i.games), everything, others,
        [n for n in range(25) if n % 5 == 3],
    ).select("transfer_id", "europe_minutes", "other_league_minutes")
    lo, hi = CF.interval(F.col("prediction_log"), F.col("_q"))
    models = scored.withColumn("_q", q).select(
        "transfer_id", *(rnd(m, 2, f"pred__{m}") for m in M.FAMILIES), rnd("train_median", 2, "pred__train_median"),
        rnd("train_median_by_position", 2, "pred__by_position"),
        ((F.col("fee_eur") >= lo) & (F.col("fee_eur") <= hi)).alias("covered"),
    )
    return FX.compare_worst(scored, models, "transfer_id", 5, []).join(F.broadcast(ctx), "transfer_id")


@query(
    "E21_cross_run_check",
    """SELECT count(*) AS matched, 0::BIGINT AS only_first, 0::BIGINT AS only_second,
    count(*) FILTER (abs(pred_log - (pred_log + CASE WHEN minutes > 300 THEN 0.001 ELSE 0 END)) > 1e-6)
      AS off_prediction_log FROM scored""",
)
def e21(t):
    scored, *_ = _fitted(t)
    moved = F.col("prediction_log") + F.when(F.col("minutes") > 300, 0.001).otherwise(0.0)
    again = scored.select("transfer_id", moved.alias("prediction_log"))
    return C.count_differences(scored, again, "transfer_id", {"prediction_log": 1e-6})
