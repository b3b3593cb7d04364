"""DuckDB text for the registered queries: plain joins and windows over the raw tables.

``CTES`` holds named building blocks; ``sql(body)`` prepends those a body uses, in order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _uses(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", text)]


def sql(body: str) -> str:
    need: set[str] = set()
    todo = _uses(body)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in _uses(CTES[n]) if m != n]
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def R(expr: str, digits: int) -> str:
    """The display rounding of the Spark side (cut off the decimal midpoints)."""
    scale = f"1{'0' * digits}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.4321) / {scale})"


# Lineup labels and their groups, as in the package's tables.
LABELS = (
    "['Goalkeeper','Centre-Back','Left-Back','Right-Back','Sweeper','Defender',"
    "'Defensive Midfield','Central Midfield','Attacking Midfield','Left Midfield',"
    "'Right Midfield','midfield','Midfield','Centre-Forward','Second Striker',"
    "'Left Winger','Right Winger','Attack','Bench']"
)
GROUP = (
    "CASE WHEN {0} = 'Goalkeeper' THEN 'GK' "
    "WHEN {0} IN ('Centre-Back','Left-Back','Right-Back','Sweeper','Defender') THEN 'DF' "
    "WHEN {0} IN ('Defensive Midfield','Central Midfield','Attacking Midfield','Left Midfield',"
    "'Right Midfield','midfield','Midfield') THEN 'MF' "
    "WHEN {0} IN ('Centre-Forward','Second Striker','Left Winger','Right Winger','Attack') "
    "THEN 'FW' END"
)
SOURCE = "(19951,19952,19961,19962,19971,19972,19981,19982,19991,19992,20001,20002,20011)"
STUDY = "(19961,19962,19971,19972,19981,19982,19991,19992,20001,20002,20011)"

cte(
    "games_all",
    """SELECT o_orderkey AS game_id, CAST(o_orderkey % 25 AS INT) AS competition_id,
    CAST(year(d) * 10 + CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS INT) AS season_id,
    d AS match_date, o_custkey % 60 AS home_club_id,
    (o_custkey % 60 + 1 + o_orderkey % 59) % 60 AS away_club_id,
    CASE WHEN NOT late THEN CAST(o_orderkey % 4 AS DOUBLE) END AS home_club_goals,
    CASE WHEN NOT late THEN CAST(o_custkey % 3 AS DOUBLE) END AS away_club_goals,
    NOT late AS played
    FROM (SELECT *, o_orderstatus = 'P' AND d >= DATE '2001-07-01' AS late FROM (
          SELECT *, CASE WHEN month(o_orderdate) IN (6, 12) THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE)
            ELSE CAST(o_orderdate AS DATE) END AS d FROM orders))""",
)
cte("games", "SELECT * FROM games_all WHERE competition_id % 5 <= 2")
cte(
    "seasons",
    """SELECT *, n_games = expected_games AND n_played = expected_games AS complete FROM (
    SELECT season_id, min(match_date) AS first_match, max(match_date) AS last_match,
    count(DISTINCT game_id) AS n_games, CAST(sum(played::INT) AS BIGINT) AS n_played,
    CAST(count(*) * 5 // count(DISTINCT month(match_date)) AS BIGINT) AS expected_games
    FROM games GROUP BY season_id)""",
)
cte(
    "cycles",
    """SELECT * FROM (SELECT season_id, lag(last_match + 1) OVER (ORDER BY season_id) AS cycle_start,
    last_match + 1 AS cycle_end FROM seasons) WHERE cycle_start IS NOT NULL""",
)
cte(
    "win",
    """SELECT (SELECT cycle_start FROM cycles WHERE season_id = 19961) AS s,
    (SELECT cycle_end FROM cycles WHERE season_id = 20011) AS e,
    (SELECT cycle_start FROM cycles WHERE season_id = 20002) AS t""",
)
_APPS = """SELECT l_orderkey AS game_id, l_partkey AS player_id, season_id, match_date,
    competition_id,
    CASE WHEN l_linenumber % 2 = 0 THEN home_club_id ELSE away_club_id END AS club_id,
    l_quantity AS minutes, (l_returnflag = 'R')::INT AS goals, (l_returnflag = 'A')::INT AS assists,
    (l_linestatus = 'O')::INT AS yellow_cards, (l_tax = 0)::INT AS red_cards,
    CAST(l_shipdate AS DATE) AS ship_date, l_linenumber
    FROM lineitem JOIN {0} ON l_orderkey = game_id"""
cte("apps_all", _APPS.format("games_all"))
cte("apps", _APPS.format("games"))
cte(
    "lineups_raw",
    f"""SELECT CASE WHEN l_orderkey % 5 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS game_id, l_partkey AS player_id,
    {LABELS}[CAST((l_orderkey * 7 + l_partkey * 3) % 20 + 1 AS BIGINT)] AS position
    FROM lineitem""",
)
cte(
    "lineups",
    f"""SELECT game_id, player_id, {GROUP.format('position')} AS lineup_position
    FROM (SELECT DISTINCT * FROM lineups_raw)""",
)
cte(
    "players",
    """SELECT c_custkey AS player_id, c_name AS name,
    CASE WHEN c_custkey % 211 <> 0 THEN DATE '1960-02-29' + CAST((c_custkey * 37) % 12000 AS INT) END
      AS date_of_birth,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GK' WHEN 'BUILDING' THEN 'DF'
      WHEN 'FURNITURE' THEN 'MF' WHEN 'HOUSEHOLD' THEN 'FW' END AS current_position
    FROM customer""",
)


def raw_moves_sql(a: int, b: int) -> str:
    return f"""SELECT o_orderkey * 2 + copy AS source_row, o_orderkey AS order_key, copy,
    CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE ' ' || o_custkey || ' ' END AS player_id,
    CASE WHEN o_orderkey % 89 = 0 THEN 'not a date'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS transfer_date,
    CAST(year(o_orderdate) AS VARCHAR) AS transfer_season,
    CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderkey % {a} AS VARCHAR) END AS from_club_id,
    CAST((o_orderkey // {a}) % {b} AS VARCHAR) AS to_club_id,
    CASE o_orderkey % 20 WHEN 0 THEN '-' WHEN 1 THEN '?' WHEN 2 THEN '' WHEN 3 THEN NULL
      WHEN 4 THEN 'abc' WHEN 5 THEN '-5' WHEN 6 THEN 'inf' WHEN 7 THEN '0.0' WHEN 8 THEN '0.0'
      ELSE CAST(o_totalprice AS VARCHAR) END AS transfer_fee
    FROM (SELECT *, 0 AS copy FROM orders UNION ALL
          SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 7 = 0)"""


def typed_moves_sql(raw: str) -> str:
    number = "TRY_CAST(trim(transfer_fee) AS DOUBLE)"
    return f"""SELECT *, CASE WHEN fee_class = 'paid' THEN number END AS fee_eur,
    substr(sha1(coalesce(CAST(player_id AS VARCHAR), '') || '|' ||
      coalesce(strftime(transfer_date, '%Y-%m-%d'), '') || '|' ||
      coalesce(CAST(from_club_id AS VARCHAR), '') || '|' ||
      coalesce(CAST(to_club_id AS VARCHAR), '')), 1, 16) AS transfer_id
    FROM (SELECT source_row, order_key, CAST(nullif(trim(player_id), '') AS BIGINT) AS player_id,
    CAST(TRY_CAST(trim(transfer_date) AS TIMESTAMP) AS DATE) AS transfer_date, transfer_season,
    CAST(from_club_id AS BIGINT) AS from_club_id, CAST(to_club_id AS BIGINT) AS to_club_id,
    transfer_fee AS raw_fee, {number} AS number,
    CASE WHEN transfer_fee IS NULL OR trim(transfer_fee) IN ('', '-', '?') THEN 'undisclosed'
      WHEN {number} IS NULL OR NOT isfinite({number}) OR {number} < 0 THEN 'malformed'
      WHEN {number} = 0 THEN 'zero_fee' ELSE 'paid' END AS fee_class
    FROM {raw})"""


def moves_sql(typed: str) -> str:
    return f"""SELECT * FROM {typed} QUALIFY row_number() OVER (PARTITION BY player_id,
    transfer_date, from_club_id, to_club_id, raw_fee, transfer_season ORDER BY source_row) = 1"""


cte("moves_raw", raw_moves_sql(97, 101))
cte("moves_typed", typed_moves_sql("moves_raw"))
cte("moves", moves_sql("moves_typed"))
cte("moves_raw3", raw_moves_sql(3, 3))
cte("moves_typed3", typed_moves_sql("moves_raw3"))
cte("moves3", moves_sql("moves_typed3"))
REASON = """CASE WHEN player_id IS NULL THEN 'missing_player_id'
    WHEN transfer_date IS NULL THEN 'missing_transfer_date'
    WHEN transfer_date < s OR transfer_date >= e THEN 'outside_study_window'
    WHEN fee_class = 'undisclosed' THEN 'undisclosed_fee'
    WHEN fee_class = 'malformed' THEN 'malformed_fee'
    WHEN fee_class = 'zero_fee' THEN 'zero_fee_free_or_loan' END"""
cte("reasoned", f"SELECT *, {REASON} AS reason FROM moves CROSS JOIN win")
cte("labeled", "SELECT *, ln(1 + fee_eur) AS fee_log1p FROM reasoned WHERE reason IS NULL")
cte("dates", "SELECT DISTINCT transfer_date AS d FROM moves WHERE transfer_date IS NOT NULL")
LOOKBACK = """SELECT d, l[1] AS completed_1, l[2] AS completed_2, ongoing,
    coalesce(len(l), 0) >= 2 AS coverage_ok FROM (
    SELECT d, list(season_id ORDER BY season_id DESC) FILTER (complete AND last_match < d) AS l,
    min(season_id) FILTER (first_match < d AND last_match >= d) AS ongoing
    FROM {0} CROSS JOIN seasons WHERE season_id IN """ + SOURCE + " GROUP BY d)"
cte("lookback", LOOKBACK.format("dates"))
cte(
    "hist",
    """SELECT a.*, lineup_position FROM apps a LEFT JOIN lineups l
    ON a.game_id = l.game_id AND a.player_id = l.player_id""",
)


def pairs_sql(cand: str, hist: str, look: str = "lookback") -> str:
    return f"""SELECT c.transfer_id, c.player_id, c.transfer_date, h.* EXCLUDE (player_id)
    FROM {cand} c JOIN {look} k ON c.transfer_date = k.d JOIN {hist} h ON c.player_id = h.player_id
    WHERE coverage_ok AND h.match_date < c.transfer_date
    AND (season_id = completed_1 OR season_id = completed_2 OR season_id = ongoing)"""


def agg_sql(pairs: str) -> str:
    n = ", ".join(
        f"count(*) FILTER (lineup_position = '{p}') AS n_{p}" for p in ("GK", "DF", "MF", "FW")
    )
    return f"""SELECT *, CASE WHEN greatest(n_GK, n_DF, n_MF, n_FW) = 0 THEN NULL
    WHEN n_GK = greatest(n_GK, n_DF, n_MF, n_FW) THEN 'GK'
    WHEN n_DF = greatest(n_DF, n_MF, n_FW) THEN 'DF'
    WHEN n_MF >= n_FW THEN 'MF' ELSE 'FW' END AS mode_position FROM (
    SELECT transfer_id, sum(goals) AS goals, sum(assists) AS assists, sum(minutes) AS minutes,
    sum((minutes > 0)::INT) AS appearances, sum(yellow_cards) AS yellow_cards,
    sum(red_cards) AS red_cards, count(DISTINCT game_id) AS lookback_match_count,
    min(match_date) AS first_match_date, max(match_date) AS last_match_date,
    array_to_string(list_sort(list(DISTINCT season_id)), ',') AS lookback_season_ids,
    count(lineup_position) AS lineup_position_rows, {n}
    FROM {pairs} GROUP BY transfer_id)"""


AGE = """CAST(year({1}) - year({0}) - CASE WHEN month({1}) * 100 + day({1}) <
    month({0}) * 100 + day({0}) THEN 1 ELSE 0 END AS INT)"""


def cand_sql(cand: str, agg: str, look: str = "lookback") -> str:
    return f"""SELECT *, CASE WHEN NOT coverage_ok THEN 'no_lookback_coverage'
    WHEN lookback_match_count IS NULL THEN 'no_league_appearances_in_lookback'
    WHEN NOT coalesce(minutes >= 30, FALSE) THEN 'insufficient_lookback_minutes'
    WHEN goals_per90 IS NULL OR assists_per90 IS NULL THEN 'invalid_per90'
    WHEN age IS NULL THEN 'missing_age' WHEN position IS NULL THEN 'missing_position' END
    AS feature_exclusion_reason FROM (
    SELECT c.*, coalesce(k.coverage_ok, FALSE) AS coverage_ok, k.completed_1, k.completed_2,
    k.ongoing, a.* EXCLUDE (transfer_id, n_GK, n_DF, n_MF, n_FW), p.name, p.date_of_birth,
    CASE WHEN minutes >= 30 AND minutes > 0 THEN 90.0::DOUBLE * goals / minutes END AS goals_per90,
    CASE WHEN minutes >= 30 AND minutes > 0 THEN 90.0::DOUBLE * assists / minutes END
      AS assists_per90,
    {AGE.format('p.date_of_birth', 'c.transfer_date')} AS age,
    coalesce(mode_position, current_position) AS position,
    CASE WHEN mode_position IS NOT NULL THEN 'historical_appearance'
      WHEN current_position IS NOT NULL THEN 'current_proxy' END AS position_source,
    mode_position IS NULL AND current_position IS NOT NULL AS position_is_proxy
    FROM {cand} c LEFT JOIN {look} k ON c.transfer_date = k.d
    LEFT JOIN {agg} a ON c.transfer_id = a.transfer_id
    LEFT JOIN players p ON c.player_id = p.player_id)"""


cte("pairs", pairs_sql("labeled", "hist"))
cte("lookagg", agg_sql("pairs"))
cte("candidates", cand_sql("labeled", "lookagg"))
cte(
    "feats",
    """SELECT f.*, c.season_id AS transfer_cycle,
    CASE WHEN transfer_date >= t THEN 'test' ELSE 'train' END AS partition_
    FROM (SELECT * FROM candidates WHERE feature_exclusion_reason IS NULL) f
    LEFT JOIN cycles c ON transfer_date >= cycle_start AND transfer_date < cycle_end""",
)
cte("train", "SELECT * FROM feats WHERE partition_ = 'train'")
cte("test", "SELECT * FROM feats WHERE partition_ = 'test'")
cte(
    "qualified",
    """SELECT m.*, c.season_id AS cycle FROM moves m
    JOIN cycles c ON transfer_date >= cycle_start AND transfer_date < cycle_end
    WHERE fee_eur > 0 AND (
      (c.season_id, from_club_id) IN (SELECT (season_id, club_id) FROM apps) OR
      (c.season_id, to_club_id) IN (SELECT (season_id, club_id) FROM apps))""",
)
cte(
    "level",
    """SELECT d.transfer_date, ln(quantile_cont(fee_eur, 0.5)) AS league_price_level,
    count(fee_eur) AS price_level_transfers
    FROM (SELECT DISTINCT transfer_date FROM feats) d LEFT JOIN qualified q
    ON q.transfer_date >= d.transfer_date - 365 AND q.transfer_date < d.transfer_date
    GROUP BY d.transfer_date""",
)
cte(
    "team_matches",
    """SELECT season_id, max(g)::DOUBLE AS m FROM (SELECT season_id, club_id,
    count(DISTINCT game_id) AS g FROM apps GROUP BY ALL) GROUP BY season_id""",
)
cte(
    "shares",
    """SELECT season_id, d, (SELECT count(*) FROM games g WHERE g.season_id = s.season_id
    AND g.match_date < d) / expected_games AS share
    FROM seasons s JOIN (SELECT DISTINCT ongoing, transfer_date AS d FROM feats) x
    ON x.ongoing = s.season_id""",
)
cte(
    "exposed",
    """SELECT *, goals / equivalents AS goals_per_season, assists / equivalents AS
    assists_per_season, minutes / (90 * available) AS minutes_share,
    appearances / available AS appearance_share,
    CASE WHEN ongoing IS NULL THEN 'off_season' ELSE 'in_season' END AS window_ FROM (
    SELECT f.*, coalesce(share, 0) AS ongoing_season_share,
    (completed_1 IS NOT NULL)::INT + (completed_2 IS NOT NULL)::INT + coalesce(share, 0)
      AS equivalents,
    coalesce(t1.m, 0) + coalesce(t2.m, 0) + coalesce(t3.m, 0) * coalesce(share, 0) AS available
    FROM feats f LEFT JOIN shares x ON f.ongoing = x.season_id AND f.transfer_date = x.d
    LEFT JOIN team_matches t1 ON completed_1 = t1.season_id
    LEFT JOIN team_matches t2 ON completed_2 = t2.season_id
    LEFT JOIN team_matches t3 ON ongoing = t3.season_id)""",
)
cte(
    "points",
    """SELECT a.*, CASE WHEN home_club_goals IS NULL OR away_club_goals IS NULL THEN NULL
    WHEN (CASE WHEN club_id = home_club_id THEN home_club_goals - away_club_goals
          ELSE away_club_goals - home_club_goals END) > 0 THEN 3.0
    WHEN home_club_goals = away_club_goals THEN 1.0 ELSE 0.0 END::DOUBLE AS points
    FROM apps a JOIN games g ON a.game_id = g.game_id""",
)
cte(
    "ctx",
    """SELECT f.transfer_id, s.first_match AS lookback_window_start,
    coalesce(sum(h.minutes) FILTER (h.competition_id % 5 = 3), 0)::DOUBLE AS europe_minutes,
    coalesce(sum(h.minutes) FILTER (h.competition_id % 5 = 4), 0)::DOUBLE AS other_league_minutes,
    coalesce(sum(h.goals) FILTER (h.competition_id % 5 = 4), 0)::DOUBLE AS other_league_goals
    FROM feats f JOIN seasons s ON s.season_id = f.completed_2
    LEFT JOIN apps_all h ON h.player_id = f.player_id AND h.match_date < f.transfer_date
      AND h.match_date >= s.first_match
    GROUP BY f.transfer_id, s.first_match""",
)
cte(
    "team_ppg",
    """SELECT f.transfer_id, avg(p.points) AS team_points_per_game FROM feats f JOIN points p
    ON p.player_id = f.player_id AND p.match_date < f.transfer_date AND p.minutes > 0
    AND (season_id = completed_1 OR season_id = completed_2 OR season_id = ongoing)
    GROUP BY f.transfer_id""",
)
cte(
    "vals",
    """SELECT * FROM (SELECT l_partkey AS player_id, CAST(l_shipdate AS DATE) AS valuation_date,
    CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN -l_extendedprice
    ELSE l_extendedprice END AS market_value_eur FROM lineitem) WHERE market_value_eur > 0""",
)
cte("val_days", "SELECT player_id, valuation_date, max(market_value_eur) AS v FROM vals GROUP BY ALL")


def asof_sql(rows: str) -> str:
    return f"""SELECT r.*, valuation_date, CAST(transfer_date - valuation_date AS INT) AS age_days,
    CASE WHEN valuation_date IS NULL THEN 'no_prior_valuation'
      WHEN transfer_date - valuation_date > 120 THEN 'stale' ELSE 'matched' END AS status,
    CASE WHEN transfer_date - valuation_date <= 120 THEN v END AS market_value_eur
    FROM {rows} r ASOF LEFT JOIN val_days q
    ON r.player_id = q.player_id AND r.transfer_date > q.valuation_date"""


# The whole grid of linear models on all inputs, per expanding fold (f) and on all training rows (f = -1): centred
# cross products, numeric inputs scaled, one Gauss-Jordan step per CTE. A pivot that vanishes (the four
# position columns sum to one) keeps weight zero, which changes no prediction. Elastic nets first go through
# rounds of soft thresholds, one coefficient per step, which tell the coefficients that are not zero and their
# signs; the same elimination then solves for those.
NUMBERS = ("goals", "assists", "minutes", "appearances", "goals_per90", "assists_per90", "age")
GROUPS = ("GK", "DF", "MF", "FW")
ALPHAS = (0.0, 0.1, 1.0, 10.0, 100.0)
NETS = [(a, r) for a in (0.1, 1.0, 10.0) for r in (0.15, 0.5, 0.85)]
GRID = "(VALUES " + ", ".join(
    [f"({k}, '{'linear' if a == 0 else 'ridge'}', '{'linear' if a == 0 else f'ridge(alpha={a})'}')" for k, a in enumerate(ALPHAS)]
    + [f"({k}, 'elastic_net', 'elastic_net(alpha={a}, l1_ratio={r})')" for k, (a, r) in enumerate(NETS, len(ALPHAS))]) + ") g(k, family, candidate)"
_NETS = "(VALUES " + ", ".join(f"({k}, {a * r!r}::DOUBLE, {a * (1 - r)!r}::DOUBLE)" for k, (a, r) in enumerate(NETS, len(ALPHAS))) + ") v(k, l1, l2)"
_SWEEPS = 150
_P = len(NUMBERS) + len(GROUPS)
_X = "[" + ", ".join([f"{c}::DOUBLE" for c in NUMBERS] + [f"coalesce(position = '{g}', FALSE)::INT::DOUBLE" for g in GROUPS]) + "]"
cte(
    "folds",
    """SELECT row_number() OVER (ORDER BY transfer_cycle) - 1 AS fold, transfer_cycle AS val FROM (
    SELECT DISTINCT transfer_cycle FROM train ORDER BY 1 DESC LIMIT 3)""",
)
cte("design", f"SELECT *, {_X} AS x FROM feats")
cte("fitrows", """SELECT fold AS f, fee_log1p AS y, x FROM folds JOIN design ON partition_ = 'train' AND transfer_cycle < val
    UNION ALL SELECT -1, fee_log1p, x FROM design WHERE partition_ = 'train'""")
_COV = ", ".join("[" + ", ".join(f"covar_pop(x[{i}], x[{j}])" for j in range(1, _P + 1)) + "]" for i in range(1, _P + 1))
cte(
    "grams",
    f"""SELECT f, count(*) AS n, avg(y) AS my, [{', '.join(f'avg(x[{i}])' for i in range(1, _P + 1))}] AS m, [{_COV}] AS c,
    [{', '.join(f'covar_pop(x[{i}], y)' for i in range(1, _P + 1))}] AS cy,
    [{', '.join(f'CASE WHEN stddev_pop(x[{i}]) > 0 THEN stddev_pop(x[{i}]) ELSE 1 END' if i <= len(NUMBERS) else '1.0::DOUBLE' for i in range(1, _P + 1))}]
      AS sd FROM fitrows GROUP BY f""",
)
_I = f"range(1, {_P + 1})"
cte(
    "std",
    f"""SELECT f, n, my, m, sd, list_transform({_I}, lambda i: list_transform({_I}, lambda j: c[i][j] / (sd[i] * sd[j]))) AS q,
    list_transform({_I}, lambda i: cy[i] / sd[i]) AS cq FROM grams""",
)
cte(
    "nets",
    f"""SELECT f, k, 0 AS step, list_transform({_I}, lambda i: 0.0::DOUBLE) AS w FROM std CROSS JOIN {_NETS} UNION ALL
    SELECT f, k, step + 1, list_transform({_I}, lambda i: CASE WHEN i = pos THEN sign(gap) * greatest(abs(gap) - l1, 0) / (q[pos][pos] + l2) ELSE w[i] END)
    FROM (SELECT *, cq[pos] + q[pos][pos] * w[pos] - list_sum(list_transform({_I}, lambda i: q[pos][i] * w[i])) AS gap
      FROM (SELECT f, k, step, w, q, cq, l1, l2, step % {_P} + 1 AS pos FROM nets JOIN std USING (f) JOIN {_NETS} USING (k) WHERE step < {_P * _SWEEPS}))""",
)
cte(
    "gj0",
    f"""SELECT f, k, alpha, my, m, sd, list_transform({_I}, lambda i: list_transform(range(1, {_P + 2}), lambda j:
      CASE WHEN j = {_P + 1} THEN cq[i] ELSE q[i][j] + CASE WHEN i = j THEN alpha / n ELSE 0 END END)) AS a
    FROM std CROSS JOIN (VALUES {', '.join(f'({k}, {x}::DOUBLE)' for k, x in enumerate(ALPHAS))}) v(k, alpha)
    UNION ALL SELECT f, k, NULL, my, m, sd, list_transform({_I}, lambda i: list_transform(range(1, {_P + 2}), lambda j:
      CASE WHEN w[i] = 0 THEN (i = j)::INT::DOUBLE WHEN j = {_P + 1} THEN cq[i] - l1 * sign(w[i])
        WHEN w[j] = 0 THEN 0.0 ELSE q[i][j] + CASE WHEN i = j THEN l2 ELSE 0 END END)) AS a
    FROM std JOIN (SELECT f, k, w FROM nets WHERE step = {_P * _SWEEPS}) USING (f) JOIN {_NETS} USING (k)""",
)
for _k in range(1, _P + 1):
    cte(
        f"gj{_k}",
        f"""SELECT f, k, alpha, my, m, sd, CASE WHEN abs(a[{_k}][{_k}]) < 1e-10
      THEN list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = {_k} THEN list_transform(a[i], lambda v: 0.0::DOUBLE) ELSE a[i] END)
      ELSE list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = {_k} THEN list_transform(a[i], lambda v: v / a[{_k}][{_k}])
        ELSE list_transform(range(1, {_P + 2}), lambda j: a[i][j] - a[i][{_k}] * a[{_k}][j] / a[{_k}][{_k}]) END) END AS a
    FROM gj{_k - 1}""",
    )
cte(
    "fits",
    f"""SELECT *, my - list_sum(list_transform(range(1, {_P + 1}), lambda i: w[i] * m[i])) AS b FROM (
    SELECT f, k, alpha, my, m, sd, list_transform(range(1, {_P + 1}), lambda i: a[i][{_P + 1}] / sd[i]) AS w FROM gj{_P})""",
)
FIT = f"(b + list_sum(list_transform(range(1, {_P + 1}), lambda i: w[i] * x[i])))"
cte(
    "cv",
    f"""SELECT k, family, candidate, fold, count(*) AS rows, avg(abs(fee_log1p - {FIT})) AS log_mae FROM folds JOIN fits ON f = fold JOIN {GRID} USING (k)
    JOIN design ON partition_ = 'train' AND transfer_cycle = val GROUP BY ALL""",
)
cte("cvsum", "SELECT k, family, candidate, round_even(avg(log_mae), 4) AS m, round_even(stddev_pop(log_mae), 4) AS s FROM cv GROUP BY ALL")
cte("finalists", "SELECT *, row_number() OVER (ORDER BY m, s, k) = 1 AS selected FROM cvsum QUALIFY row_number() OVER (PARTITION BY family ORDER BY m, s, k) = 1")
cte("chosen", "SELECT f, w, b FROM fits JOIN finalists USING (k) WHERE selected")
cte("predicted", f"SELECT d.*, {FIT} AS pred_log FROM design d CROSS JOIN (SELECT w, b FROM chosen WHERE f = -1)")
cte(
    "oof",
    f"""SELECT transfer_id, fold, fee_log1p - {FIT} AS r FROM folds JOIN chosen ON f = fold
    JOIN design ON partition_ = 'train' AND transfer_cycle = val""",
)


def quantile_k(level: str) -> str:
    return f"CAST(ceil((count(*) + 1)::DOUBLE * {level}::DOUBLE) AS BIGINT)"


cte(
    "q80",
    f"""SELECT r AS q FROM (SELECT abs(r) AS r, row_number() OVER (ORDER BY abs(r)) AS i FROM oof)
    WHERE i = (SELECT {quantile_k('0.8')} FROM oof)""",
)
cte(
    "base",
    """SELECT quantile_cont(fee_eur, 0.5) AS med, avg(fee_eur) AS mean FROM train""",
)
cte(
    "bypos",
    "SELECT position, quantile_cont(fee_eur, 0.5) AS med FROM train GROUP BY position",
)
FAMILIES = ("linear", "ridge", "elastic_net")


def _log_of(family: str) -> str:
    """Log prediction of a family's best candidate for a row of the design."""
    own = FIT.replace("w[", f"w_{family}[").replace("(b +", f"(b_{family} +")
    return own


cte(
    "scored",
    f"""SELECT t.*, greatest(exp(pred_log) - 1, 0) AS pred,
    {', '.join(f'{_log_of(m)} AS g_{m}, greatest(exp({_log_of(m)}) - 1, 0) AS p_{m}' for m in FAMILIES)},
    base.med AS p_median, base.mean AS p_mean, coalesce(bypos.med, base.med) AS p_pos,
    bypos.med IS NULL AS fallback,
    fee_eur - greatest(exp(pred_log) - 1, 0) AS residual,
    abs(fee_eur - greatest(exp(pred_log) - 1, 0)) AS abs_error,
    fee_log1p - pred_log AS log_res
    FROM predicted t {' '.join(f"CROSS JOIN (SELECT w AS w_{m}, b AS b_{m} FROM fits JOIN finalists USING (k) WHERE f = -1 AND family = '{m}')" for m in FAMILIES)}
    CROSS JOIN base LEFT JOIN bypos ON t.position = bypos.position WHERE partition_ = 'test'""",
)
