import datetime as dt

import pytest
from pyspark.sql import functions as F
from snapshot import END, FIRST, GAMES, LAST, SEASONS, START, STUDY, TEST_START, close, day, expected_lookback

from pitlake.operators import asof as A
from pitlake.operators import contracts as C
from pitlake.operators import labels as L
from pitlake.operators import seasons as T
from pitlake.operators import split as P


def test_lookback_resolution(spark, snap):
    edges = [d + dt.timedelta(days=k) for s in SEASONS for d in (FIRST[s], LAST[s]) for k in (-1, 0, 1)]
    days = sorted({*edges, dt.date(1999, 1, 1), dt.date(2030, 1, 1)})
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = T.attach_lookback(df, "d", snap.seasons, SEASONS).collect()
    assert {r.d: (r.completed_1, r.completed_2, r.ongoing, r.coverage_ok) for r in got} == {d: expected_lookback(d) for d in days}


def test_cycles_and_window(spark, snap):
    c = {r.season_id: (str(r.cycle_start), str(r.cycle_end_exclusive)) for r in T.transfer_cycles(snap.seasons).collect()}
    after = {s: str(LAST[s] + dt.timedelta(days=1)) for s in SEASONS}
    assert c == {s: (after[s - 1], after[s]) for s in SEASONS[1:]}
    w = {r.name: r.value for r in T.study_window(snap.seasons, STUDY).collect()}
    assert (w["transfer_start"], w["transfer_end_exclusive"]) == (START, END)


def test_features_equal_brute_force(spark, snap):
    kinds = {"coverage": "incomplete_lookback", "no_league": "no_rows", "insufficient": "few_minutes", "missing_position": "no_position"}
    rows, seen = snap.candidates.collect(), set()
    assert len(rows) > 40
    for r in rows:
        e = snap.expected_features(r.player_id, r.transfer_date)
        why = r.feature_exclusion_reason
        assert (why is None) == (e["reason"] is None) and (why is None or any(why.startswith(k) and v == e["reason"] for k, v in kinds.items())), (why, e)
        seen.add(e["reason"])
        if e["matches"] and e["reason"] != "incomplete_lookback":
            assert (r.goals, r.minutes, r.lookback_match_count, r.last_match_date, r.age) == (e["goals"], e["minutes"], e["matches"], e["last"], e["age"])
            assert close(r.goals_per90, e["goals_per90"])
        if why is None:
            assert (r.position, r.position_is_proxy) == (e["position"], e["proxy"])
    assert seen == {None, "no_rows", "few_minutes", "no_position"}


def test_label_reasons_equal_brute_force(spark, snap):
    got = {r.source_row: r.label_exclusion_reason for r in snap.reasoned.collect()}
    assert got == {m[0]: snap.expected_reason(m) for m in snap.moved}


def test_later_and_same_day_rows_do_not_matter(spark, snap):
    one = snap.features.first()
    extra = snap.appearances.where(F.col("player_id") == one.player_id).limit(2).withColumn("season_id", F.lit(one.completed_1))
    extra = extra.withColumn("goals", F.lit(5.0)).withColumn("game_id", F.concat(F.lit("y"), "game_id"))
    only = snap.labels.where(F.col("transfer_id") == one.transfer_id)
    same = extra.withColumn("match_date", F.lit(one.transfer_date))
    later = extra.withColumn("match_date", F.date_add(F.lit(one.transfer_date), 3))
    cols = ["transfer_id", "goals", "minutes", "lookback_match_count", "last_match_date", "position"]
    again = snap.features_for(only, snap.appearances.unionByName(same).unionByName(later)).select(cols).collect()
    assert again == snap.candidates.where(F.col("transfer_id") == one.transfer_id).select(cols).collect()


def test_window_plan_equals_pairwise_join(spark, snap):
    c = T.attach_lookback(snap.labels, "transfer_date", snap.seasons, SEASONS).where("coverage_ok")
    a = snap.appearances.select("player_id", "season_id", "match_date", "minutes")
    hit = c.join(a, "player_id").where(
        "match_date < transfer_date and (season_id = completed_1 or season_id = completed_2 or season_id = ongoing)"
    )
    brute = hit.groupBy("transfer_id").agg(F.sum("minutes").alias("minutes"))
    fast = snap.candidates.where("minutes is not null").select("transfer_id", "minutes")
    assert brute.exceptAll(fast).count() == 0 and fast.exceptAll(brute).count() == 0


def test_partition_count_does_not_matter(spark, snap):
    cols = ["transfer_id", "goals", "minutes", "position", "lookback_season_ids"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = {tuple(r) for r in snap.features_for(snap.labels).select(cols).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = {tuple(r) for r in snap.features_for(snap.labels.repartition(5)).select(cols).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == seven


def test_value_asof(spark, snap):
    rows = snap.labels.select("transfer_id", "player_id", "transfer_date")
    out = A.asof_latest_by_day(
        rows, snap.values, "player_id", "transfer_date", "valuation_date", "market_value_eur", 200
    )
    got = {(r.player_id, r.transfer_date): (r.market_value_status, r.market_value_eur) for r in out.collect()}
    assert got == {k: snap.expected_value(*k, 200) for k in got}
    assert {s for s, _ in got.values()} == {"matched", "stale", "no_prior_valuation"}


def test_event_time_asof_against_brute_force(spark):
    import random

    rng = random.Random(3)
    clicks = [(rng.choice("abbbb"), rng.randrange(40000), float(i)) for i in range(400)]
    looks = [(i, rng.choice("abc"), rng.randrange(40000)) for i in range(200)]
    stamp = F.timestamp_seconds("s").alias("ts")
    c = spark.createDataFrame(clicks, "k string, s int, value double").select("k", stamp, "value")
    x = spark.createDataFrame(looks, "i int, k string, s int").select("i", "k", stamp)
    got = {r.i: r.prior_value for r in A.asof_latest_by_time(x, c, "k", "ts", "value", 3600).collect()}
    for i, k, s in looks:
        before = [(t, v) for kk, t, v in clicks if kk == k and t < s]
        assert got[i] == (max(before)[1] if before else None)


def test_exposure_equals_brute_force(spark, snap):
    rows = A.exposure_columns(snap.features, snap.games, snap.appearances, GAMES).collect()
    assert {r.window for r in rows} == {"in_season", "off_season"}
    for r in rows:
        e = snap.expected_features(r.player_id, r.transfer_date)
        assert close(r.ongoing_season_share, e["share"]) and close(r.lookback_season_equivalents, e["equivalents"])
        assert close(r.available_team_matches, GAMES * e["equivalents"]) and close(r.minutes_share, e["minutes"] / (90 * GAMES * e["equivalents"]))
        assert close(r.goals_per_season, e["goals"] / e["equivalents"]) and r.window == e["window"]


def test_trailing_price_window_is_strict(spark, snap):
    import math

    at = dt.date(2007, 3, 1)
    rows = [(at - dt.timedelta(days=80), 3e6, "c1"), (at - dt.timedelta(days=79), 77e6, "away"), (at, 40e6, "c1"),
            (at - dt.timedelta(days=366), 9e6, "c1"), (at - dt.timedelta(days=365), 12e6, "c2")]
    moves = spark.createDataFrame([(*r, "away") for r in rows], "transfer_date date, fee_eur double, from_club_id string, to_club_id string")
    moves = T.with_cycle(moves, "transfer_date", T.transfer_cycles(snap.seasons), "cycle")
    q = A.active_moves(moves, snap.appearances, "cycle", ("from_club_id", "to_club_id"))
    r = A.price_level(spark.createDataFrame([(at,)], "transfer_date date"), "transfer_date", q, "transfer_date", "fee_eur", 365, 3).first()
    assert r.price_level_transfers == 2 and abs(r.league_price_level - math.log((3e6 + 12e6) / 2)) < 1e-12
    assert r.below_minimum


@pytest.mark.parametrize("window", [1, 2, 7, 90, 365])
def test_trailing_median_against_brute_force(spark, window):
    import datetime as dt
    import random
    import statistics

    rng = random.Random(5)
    base = dt.date(2020, 1, 1)
    ev = [(base + dt.timedelta(days=rng.randrange(900)), rng.choice([7.5, 1e3, 2e3, 5e6 * rng.random()])) for _ in range(600)]
    ats = [base + dt.timedelta(days=d) for d in range(0, 1300, 23)]
    out = A.trailing_median(
        spark.createDataFrame([(d,) for d in ats], "t date"), "t",
        spark.createDataFrame(ev, "d date, v double"), "d", "v", window,
    )
    got = {r.t: (r.median_value, r.n_events) for r in out.collect()}
    for t in ats:
        inside = [v for d, v in ev if t - dt.timedelta(days=window) <= d < t]
        assert (t in got) == bool(inside)
        if inside:
            assert abs(got[t][0] - statistics.median(inside)) < 1e-9 and got[t][1] == len(inside)


def test_trailing_median_of_values_that_lie_together(spark):
    """All values within 0.01 % of each other share a bucket; the steps inside it tell them apart."""
    import datetime as dt
    import random
    import statistics

    rng = random.Random(6)
    base = dt.date(2020, 1, 1)
    ev = [(base + dt.timedelta(days=rng.randrange(500)), 3e6 * (1 + 1e-4 * rng.random())) for _ in range(3000)]
    ats = [base + dt.timedelta(days=d) for d in range(0, 700, 31)]
    out = A.trailing_median(spark.createDataFrame([(d,) for d in ats], "t date"), "t", spark.createDataFrame(ev, "d date, v double"), "d", "v", 365)
    got = {r.t: r.median_value for r in out.collect()}
    for t in ats[1:]:
        inside = [v for d, v in ev if t - dt.timedelta(days=365) <= d < t]
        assert t in got and got[t] == statistics.median(inside)
    # no cutoff is spread over the days of its window: ranges start at a day of the events or a block of days
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence((t#" not in text and text.count("explode(sequence(_first") >= 3


def test_context_equals_brute_force(spark, snap):
    study = spark.createDataFrame([("HOME",)], "competition_id string")
    others = A.other_leagues(snap.competitions, study)
    assert [r.competition_id for r in others.collect()] == ["FOR"]
    from pitlake.sources.raw import context_scan

    every = context_scan(snap.raw_apps, snap.features.select("player_id").distinct())
    points = A.with_points(snap.appearances, snap.raw_games)
    rows = A.context_columns(snap.features, snap.seasons, points, every, others, ["EUR"]).collect()
    assert any(r.europe_minutes for r in rows) and any(r.other_league_goals for r in rows)
    for r in rows:
        e = snap.expected_features(r.player_id, r.transfer_date)
        assert (r.europe_minutes, r.other_league_minutes, r.other_league_goals) == (e["europe"], e["foreign"], e["foreign_goals"])
        assert r.lookback_window_start == e["start"] and close(r.team_points_per_game, e["points"])


def test_window_sums_without_a_window(spark):
    rows = spark.createDataFrame(
        [("a", None, "2020-02-01"), ("a", "2020-03-01", "2020-02-01"), ("a", "2020-01-02", "2020-02-01"), ("b", "2020-01-01", "2020-02-01")],
        "k string, s string, e string").select("k", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    history = spark.createDataFrame([("a", "2020-01-01", 7.0), ("a", "2020-01-02", 8.0)], "k string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = {(r.k, str(r.s)): r.v for r in A.window_sums(rows, history, "k", "s", "e", "d", {"v": F.col("v")}).collect()}
    assert got == {("a", "None"): None, ("a", "2020-03-01"): None, ("a", "2020-01-02"): 8.0, ("b", "2020-01-01"): 0.0}


def test_funnel_reconciles(spark, snap):
    rows = L.funnel(snap.reasoned, snap.candidates, day(TEST_START)).orderBy("pos").collect()
    by = {r.step: r.rows for r in rows}
    assert by["raw_transfer_rows_after_exact_dedup"] == snap.moves.count()
    assert by["final_supervised_rows"] == by["usable_position"] == snap.features.count()
    assert by["train_rows"] + by["test_rows"] == by["final_supervised_rows"]


def test_round_trip_null_clubs_and_window(spark):
    rows = [("t1", "p", "2020-01-01", "A", None, "paid"), ("t2", "p", "2021-02-04", None, "A", "zero_fee"),
            ("t3", "q", "2020-01-01", "A", "B", "paid"), ("t4", "q", "2021-02-05", "B", "A", "undisclosed"),
            ("t5", "r", "2020-01-01", "A", "B", "paid"), ("t6", "r", "2020-01-01", "B", "A", "zero_fee")]
    df = spark.createDataFrame(
        rows, "transfer_id string, player_id string, d string, from_club_id string, to_club_id string, fee_class string"
    ).withColumn("transfer_date", F.col("d").cast("date"))
    got = L.round_trips(df.where("fee_class = 'paid'"), df)
    assert [r.transfer_id for r in got.collect()] == ["t1"]


def test_entity_resolution(spark):
    people = spark.createDataFrame(
        [("1", "Renée  Gräfe"), ("2", "Bo Li"), ("3", "Bo Li"), ("4", "Weiß"), ("5", "Søren Ø"), ("6", "O\u2019Brien")], "player_id string, name string"
    )
    ask = spark.createDataFrame(
        [(1, "1", None), (2, "9", None), (3, None, "renee graefe"), (4, None, "Bo Li"), (5, None, "weiss"), (6, None, "x"),
         (7, None, " RENÉE\tGRÄFE"), (8, None, "Soren O"), (9, None, "O'Brien"), (10, None, "Rene\u0301e gra\u0308fe")],
        "request_id int, want_id string, want_name string",
    )
    got = {r.request_id: (r.status, r.match_kind, r.player_id) for r in A.resolve_entities(ask, people).collect()}
    none, first = ("unknown", "none", None), ("resolved", "normalised_name", "1")
    assert got == {
        1: ("resolved", "id", "1"), 2: none, 3: none, 4: ("ambiguous", "exact_name", None), 5: ("resolved", "normalised_name", "4"),
        6: none, 7: first, 8: none, 9: none, 10: first,
    }


def test_holdout_and_folds(spark):
    cycles = [2011, 2012, 2012, 2012, 2013, 2014, 2014]
    rows = [(f"t{i}", dt.date(c, 3, 1 + i), c) for i, c in enumerate(cycles)]
    df = spark.createDataFrame(rows, "transfer_id string, transfer_date date, transfer_cycle int")
    roles = P.fold_roles(df, 2).groupBy("fold", "role").agg(F.sort_array(F.collect_list("transfer_id")).alias("x"))
    want = {}
    for fold, held in enumerate((2013, 2014)):
        want[fold, "train"] = [k for k, _, c in rows if c < held]
        want[fold, "validation"] = [k for k, _, c in rows if c == held]
    assert {(r.fold, r.role): r.x for r in roles.collect()} == want
    s = {r.fold: (r.train_rows, r.validation_rows, r.usable) for r in P.fold_summary(df, 2, 2, 2).collect()}
    assert s == {0: (4, 1, False), 1: (5, 2, True)}
    split = P.with_partition(df, "transfer_date", day("2013-01-01"))
    assert split.where("partition = 'test'").count() == 3
    gates = {r.gate: r.passed for r in P.holdout_gates(split.unionByName(split.limit(1)), "transfer_id", 5, 4).collect()}
    assert gates == {"total_rows": True, "test_rows": False, "train_rows": True, "repeated_keys": False}


def test_gate_contract(spark):
    df = spark.createDataFrame([(5, 1)], "a int, b int")
    assert {(r.gate, r.passed) for r in C.gates(df, {"a": 5, "b": 2}).collect()} == {("a", True), ("b", False)}
