import pytest
from pyspark.sql import functions as F
from snapshot import GAMES, SEASONS

from pitlake.functions import scalar as S
from pitlake.operators import cleaning as K
from pitlake.operators import contracts as C
from pitlake.sources import raw as RAW


@pytest.mark.parametrize("kind,texts", [
    ("paid", {"275000.50": 275000.5, "3e4": 3e4, " 8": 8.0, "\t5\t": 5.0, "\u00a09 ": 9.0, "+2": 2.0}),
    ("zero_fee", ["0", "0.000", "-0.0", "\n0"]),
    ("undisclosed", [None, "", "  ", "-", "?", "\t-\t"]),
    ("malformed", ["free", "-1", "Infinity", "NaN", "0x10", "2f", "1 000"]),
])
def test_fee_encodings(spark, kind, texts):
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    rows = df.select("v", S.fee_class("v").alias("c"), S.fee_value("v").alias("x")).collect()
    assert {r.c for r in rows} == {kind}
    assert {r.v: r.x for r in rows} == (texts if isinstance(texts, dict) else dict.fromkeys(texts))


def test_dates_and_ids(spark):
    df = spark.createDataFrame(
        [(" 2011-10-09 00:00:00", " 7 "), ("2011-02-30", "  "), (None, None), ("\t20111009\n", "\t8\n"), ("20111399", "\u00a0")], "d string, i string"
    )
    rows = df.select(S.parse_date("d").cast("string"), S.clean_id("i")).collect()
    assert [tuple(r) for r in rows] == [("2011-10-09", "7"), (None, None), (None, None), ("2011-10-09", "8"), (None, None)]


def test_floor_age_equals_calendar(spark):
    import datetime as dt
    import random

    rng = random.Random(1)
    rows = [(dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(4000)), dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(2000))) for _ in range(300)]
    rows += [(dt.date(1996, 2, 29), dt.date(2015, 2, 28)), (dt.date(1996, 2, 29), dt.date(2015, 3, 1))]
    got = spark.createDataFrame(rows, "b date, d date").select("b", "d", S.floor_age("b", "d").alias("a")).collect()
    for r in got:
        assert r.a == r.d.year - r.b.year - ((r.d.month, r.d.day) < (r.b.month, r.b.day))


def test_surrogate_key_matches_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([("1", "2020-01-02", None, "9")], "p string, d string, a string, b string")
    got = df.select(S.surrogate_key("p", F.col("d").cast("date"), "a", "b")).first()[0]
    assert got == hashlib.sha1(b"1|2020-01-02||9").hexdigest()[:16]


def test_retransform_and_failure(spark):
    import math

    p = [-3.0, -1e-9, 0.0, 2.5, math.log1p(12345.0)]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", S.back_to_units("p").alias("u"), S.clamped("p").alias("c")).collect()
    assert all(math.isclose(r.u, max(0.0, math.expm1(r.p)), rel_tol=1e-12) and r.c == (r.p < 0) for r in rows)
    for bad in (float("nan"), float("inf"), float("-inf"), 1e4, None):
        with pytest.raises(Exception, match="non-finite"):
            spark.createDataFrame([(bad,)], "p double").select(S.back_to_units("p")).collect()


def test_transfer_copies_and_conflicts(spark, snap):
    base = snap.raw_moves.limit(1)
    twice = base.unionByName(base.withColumn("source_row", F.lit(99)))
    one = K.clean_transfers(twice)
    assert [(r.copies, r.source_row) for r in one.collect()] == [(2, base.first().source_row)]
    assert K.dedup_stats(one).first().exact_duplicates_removed == 1
    other = base.withColumn("transfer_fee", F.lit("2000000.0")).withColumn("source_row", F.lit(98))
    # two copies of each variant: still a conflict
    both = twice.unionByName(other).unionByName(other)
    bad = K.transfer_conflicts(K.type_transfers(both))
    assert [(r.variants, r.rows) for r in bad.collect()] == [(2, 4)]
    with pytest.raises(C.ContractError):
        C.require_none(bad, "conflict")


def test_league_filter_and_key_contracts(spark, snap):
    assert snap.games.count() == GAMES * len(SEASONS)
    assert snap.appearances.count() == sum(r[4] == "HOME" for r in snap.plays)
    assert C.key_violations(snap.players, "player_id").count() == 0
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {(r.k, r.problem) for r in C.key_violations(df, "k").collect()} == {
        ("a", "duplicate_key"), (None, "null_key")
    }


def test_invalid_stats_counted_after_dedup(spark, snap):
    one, other = (snap.raw_apps.where(f"player_id = '{p}' and competition_id = 'HOME'") for p in ("p0", "p2"))
    bad = other.limit(1).withColumn("minutes_played", F.lit("-3"))
    flagged, valid = K.clean_appearances(one.unionByName(bad).unionByName(bad), snap.games)
    s, n = K.appearance_stats(flagged).first(), one.count()
    assert (s.league_appearances, s.exact_duplicates_removed, s.invalid_stat_rows_removed) == (n, 1, 1)
    assert valid.count() == n and s.appearance_vs_game_date_mismatch == 0


def test_appearance_conflicts_and_source_order(spark, snap):
    one = snap.raw_apps.where("player_id = 'p0' and competition_id = 'HOME'").limit(1)
    other = one.withColumn("goals", F.lit("9"))
    copy = one.withColumn("appearance_id", F.lit("0-first-by-name"))
    rows = one.withColumn("source_row", F.lit(1)).unionByName(copy.withColumn("source_row", F.lit(2)))
    assert K.clean_appearances(rows, snap.games)[1].first().appearance_id == one.first().appearance_id
    flagged, _ = K.clean_appearances(one.unionByName(other), snap.games)
    assert [(r.variants, r.rows) for r in K.appearance_conflicts(flagged).collect()] == [(2, 2)]
    assert [r.problem for r in K.appearance_id_violations(flagged).collect()] == ["duplicate_key"]
    with pytest.raises(C.ContractError):
        C.require_none(K.appearance_conflicts(flagged), "conflict")
    clean, _ = K.clean_appearances(snap.raw_apps, snap.games)
    assert K.appearance_conflicts(clean).count() == 0 and K.appearance_id_violations(clean).count() == 0
    label = snap.raw_lineups.limit(1)
    both = K.clean_lineups(label.unionByName(label).unionByName(label.withColumn("position", F.lit("Bench"))), snap.games)
    assert [(r.variants, r.rows) for r in K.lineup_conflicts(both).collect()] == [(2, 2)]
    assert K.lineup_conflicts(snap.lineups).count() == 0


def _raw(snap):
    return {"games": snap.raw_games, "players": snap.raw_players, "transfers": snap.raw_moves, "appearances": snap.raw_apps,
            "game_lineups": snap.raw_lineups}


def test_ingest_gives_the_cleaned_tables(snap):
    got = K.ingest(_raw(snap), ["HOME"])
    for name, want in (("games", snap.games), ("players", snap.players), ("appearances", snap.appearances), ("lineups", snap.lineups)):
        assert got[name].count() == want.count() and C.changed_rows(got[name], want, [want.columns[0]], want.columns).isEmpty(), name
    assert sorted(r.transfer_id for r in got["moves"].collect()) == sorted(r.transfer_id for r in snap.moves.collect())


@pytest.mark.parametrize("table,change,message", [
    ("games", {"date": "x"}, "game_id is not unique"),
    ("players", {"name": "Another"}, "player_id"),
    ("transfers", {"transfer_fee": "77"}, "several fees"),
    ("appearances", {"goals": "99"}, "appearances of one game"),
    ("game_lineups", {"position": None}, "lineup labels"),
])
def test_ingest_fails_on_a_broken_contract(snap, table, change, message):
    raw = _raw(snap)
    row = raw[table].where("competition_id = 'HOME'").limit(1) if "competition_id" in raw[table].columns else raw[table].limit(1)
    if table == "game_lineups":
        row = raw[table].join(snap.games.select("game_id"), "game_id").where("position is not null").select(raw[table].columns).limit(1)
    again = row.withColumns({c: F.lit(v).cast(raw[table].schema[c].dataType) for c, v in change.items()})
    with pytest.raises(C.ContractError, match=message):
        K.ingest({**raw, table: raw[table].unionByName(again)}, ["HOME"])


def test_capabilities_that_are_missing(spark):
    rows = [(k, v) for k, v in C.REQUIRED.items() if k not in ("moves_with_date", "birth_date_share", "any_paid")]
    rows += [("moves_with_date", 0.99), ("birth_date_share", 0.96), ("any_paid", None), ("lineup_share", 0.0)]
    found = C.missing_capabilities(spark.createDataFrame(rows, "metric string, value double")).collect()
    assert sorted(r.metric for r in found) == ["any_paid", "moves_with_date"]


def test_competition_identity(spark, snap):
    good = snap.competitions.where("competition_id = 'HOME'")
    bad = spark.createDataFrame(
        [("HOME", "another-code", "domestic_league"), ("ZZ", "z", "domestic_league")], snap.competitions.schema
    )
    assert C.reference_mismatches(good, snap.competitions, "competition_id").count() == 0
    found = C.reference_mismatches(bad, snap.competitions, "competition_id").collect()
    assert {(r.competition_id, r.problem) for r in found} == {("HOME", "differs"), ("ZZ", "absent")}


def test_missing_column_is_an_error(spark, snap):
    with pytest.raises(C.ContractError, match="missing"):
        RAW.typed_scan(snap.competitions, {"competition_id": "string", "nope": "string"})


def test_gzip_csv_scan_keeps_text(spark, tmp_path):
    import gzip

    path = str(tmp_path / "players.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("player_id,name,extra\n007,A,x\n")
    got = RAW.read_csv_text(spark, path, ["player_id", "name"])
    assert [tuple(r) for r in got.collect()] == [("007", "A")]


def test_quoted_csv(spark, tmp_path):
    path = str(tmp_path / "people.csv")
    with open(path, "w") as f:
        f.write('player_id,name,date_of_birth,position\n1,"Ana ""Flea"", Jr",1990-01-01,Attack\n2,"two\nlines",NA,\n3,back\\slash,n/a,"N/A"\n')
    got = RAW.read_csv_text(spark, path, ["player_id", "name", "date_of_birth", "position"])
    assert sorted(map(tuple, got.collect())) == [
        ("1", 'Ana "Flea", Jr', "1990-01-01", "Attack"), ("2", "two\nlines", None, None), ("3", "back\\slash", None, None)]


def test_hash_verification(spark, tmp_path):
    import hashlib

    for name, body in (("a.bin", b"1"), ("b.bin", b"2"), ("c.bin", b"3")):
        (tmp_path / name).write_bytes(body)
    actual = RAW.file_hashes(spark, f"{tmp_path}/*.bin")
    rec = [("a.bin", hashlib.sha256(b"1").hexdigest()), ("b.bin", "0"), ("d.bin", "0")]
    recorded = spark.createDataFrame(rec, "file string, sha256 string")
    assert {(r.file, r.problem) for r in RAW.verify_hashes(actual, recorded).collect()} == {
        ("b.bin", "differs"), ("c.bin", "unrecorded"), ("d.bin", "missing")
    }


def test_part_files_of_equal_names_in_two_tables(spark, tmp_path):
    for table, name, body in (("a.bin", "part-0", b"1"), ("b.bin", "part-0", b"2"), ("b.bin", "part-1", b"3")):
        (tmp_path / table).mkdir(exist_ok=True)
        (tmp_path / table / name).write_bytes(body)
    (tmp_path / "c.bin").write_bytes(b"4")
    files = RAW.file_hashes(spark, f"{tmp_path}/*.bin")
    assert {r.file for r in files.collect()} == {"a.bin/part-0", "b.bin/part-0", "b.bin/part-1", "c.bin"}
    assert RAW.verify_hashes(files, files).isEmpty()
    tables = {r.file: r for r in RAW.table_hashes(files).collect()}
    assert {f: r.bytes for f, r in tables.items()} == {"a.bin": 1, "b.bin": 2, "c.bin": 1}
    (tmp_path / "b.bin" / "part-1").write_bytes(b"5")
    assert [tuple(r) for r in RAW.verify_hashes(RAW.table_hashes(files), spark.createDataFrame(list(tables.values()))).collect()] == [("b.bin", "differs")]


def test_a_file_larger_than_a_row_is_hashed(spark, tmp_path):
    """A row holds at most 2 GB; the file is sparse, so that it takes no room."""
    import hashlib

    size = 2**31 + 4096
    with open(tmp_path / "large file.bin", "wb") as f:
        f.write(b"head")
        f.truncate(size)
    want, zeros = hashlib.sha256(b"head"), bytes(1 << 22)
    left = size - 4
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    (r,) = RAW.file_hashes(spark, f"{tmp_path}/*.bin").collect()
    assert (r.file, r.bytes, r.sha256) == ("large file.bin", size, want.hexdigest())


def _history(spark):
    import datetime as dt

    day = dt.date(2020, 1, 10)
    rows = [(p, day - dt.timedelta(days=k), float(k)) for p in ("a", "b", "c") for k in range(1, 6)]
    cutoffs = spark.createDataFrame([(f"{p}{i}", p, day - dt.timedelta(days=2 * i)) for p in ("a", "b", "c") for i in range(2)],
                                    "id string, player string, at date")
    return spark.createDataFrame(rows, "player string, day date, v double"), cutoffs


@pytest.mark.parametrize("condition,leaks", [("day < at", 0), ("day <= at", 3), ("day <= date_add(at, 1)", 3)])
def test_a_planted_leak_is_caught(spark, condition, leaks):
    history, cutoffs = _history(spark)

    def build(rows):
        j = cutoffs.join(rows, "player", "left").withColumn("v", F.when(F.expr(condition), F.col("v")))
        return j.groupBy("id").agg(F.sum("v").alias("total"), F.max("v").alias("top"), F.min(F.when(F.col("v") < 0, 1)).alias("nothing"))

    later = C.later_rows(cutoffs.select("player", "at"), "player", "at", "day", {"v": F.lit(1e6)})
    assert later.count() == 6
    found = C.future_leaks(build, history, later, ["id"], ["total", "top", "nothing"]).collect()
    assert len(found) == leaks and all((r.fewer, r.more) == (1, 1) for r in found)


def test_changed_rows_tell_nulls_apart(spark):
    a = spark.createDataFrame([("k", None, 1), ("k", 2, None), ("m", 1, 1), ("m", 1, 1), (None, None, None)], "k string, x int, y int")
    b = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("m", 1, 1), (None, None, None)], "k string, x int, y int")
    assert sorted(map(tuple, C.changed_rows(a, b, ["k"], ["x", "y"]).collect())) == [("k", 1, 1), ("m", 1, 0)]
    assert C.changed_rows(a, a, ["k"], ["x", "y"]).isEmpty()


def test_fingerprint_ignores_order_not_content(spark, snap):
    cols = [F.col("player_id"), F.col("name"), F.col("current_position")]
    a = RAW.fingerprint(snap.players, cols).first()
    assert RAW.fingerprint(snap.players.orderBy(F.desc("name")), cols).first() == a
    changed = snap.players.withColumn("name", F.upper("name"))
    assert RAW.fingerprint(changed, cols).first() != a


def test_null_label_conflicts_in_the_query(spark, tmp_path):
    from registry.queries import QUERIES

    # Labels go by (7 * order + 3 * part) % 20, and 19 has none: orders 2 and 501 are one game of player 35.
    lines = [(2, 35), (501, 35), (2, 35), (3, 1), (502, 1), (4, 1), (4, 1), (2, 135), (501, 435)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    groups: dict = {}
    for order, part in lines:
        groups.setdefault((str(order % 499), str(part)), set()).add((order * 7 + part * 3) % 20)
    assert 19 in groups["2", "35"] and len(groups["2", "35"]) == 2
    got = QUERIES["Q7_lineup_conflicts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((*k, len(v), len(v)) for k, v in groups.items() if len(v) > 1)
