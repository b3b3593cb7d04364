"""Plan shape and hot keys: no pairwise joins, and a hot entity shrinks before it is grouped on."""

from pyspark.sql import functions as F
from snapshot import SEASONS

from pitlake.functions import ranks as RK
from pitlake.operators import asof as A
from pitlake.operators import contracts as C
from pitlake.operators import evaluate as E
from pitlake.operators import labels as L
from pitlake.operators import seasons as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_plans(spark, snap):
    moves = T.with_cycle(snap.moves, "transfer_date", T.transfer_cycles(snap.seasons), "cycle")
    active = A.active_moves(moves, snap.appearances, "cycle", ("from_club_id", "to_club_id"))
    feats = snap.features
    frames = [
        snap.features_for(snap.labels),
        active,
        A.trailing_median(feats, "transfer_date", active, "transfer_date", "fee_eur", 365),
        A.asof_latest_by_day(
            feats, snap.values, "player_id", "transfer_date", "valuation_date", "market_value_eur", 365
        ).drop("market_value_eur"),
        A.exposure_columns(feats, snap.games, snap.appearances, 4),
        L.round_trips(snap.labels, snap.moves),
        RK.exact_median(feats, "fee_eur", "m", ["position"]),
        RK.equal_count_bands(feats, "fee_eur", "transfer_id", 4),
        E.paired_cluster_bootstrap(
            feats, "player_id", {"a": F.col("goals") * 1.0, "b": F.col("assists") * 1.0}, "a", 50, 1, 0.9
        ),
    ]
    for df in frames:
        text = plan(df)
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_hot_entity_is_one_row_per_day(spark):
    """Two thirds of the rows sit on one entity; totals equal a direct per-cutoff count."""
    n = 30_000
    hist = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 500).alias("player_id"),
        F.lit(1).alias("season_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 97).cast("int")).alias("match_date"),
        F.lit(1.0).alias("minutes"),
    )
    daily = A.daily_totals(hist, ["player_id"], "match_date", {"minutes": F.col("minutes")})
    assert daily.where("player_id = 0").count() <= 97
    cuts = spark.range(2000).select(
        F.lit(0).cast("bigint").alias("player_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 120).cast("int")).alias("d"),
    )
    got = A.totals_before(cuts, "d", daily, ["player_id"], ["minutes"])
    want = (
        cuts.distinct().join(hist, "player_id").where("match_date < d").groupBy("player_id", "d")
        .agg(F.sum("minutes").alias("minutes"))
    )
    cols = ["player_id", "d", "minutes"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0


def test_copies_collapse_before_the_shuffle(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("source_row"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
    )
    one = C.first_per_key(df, ["k"], "source_row")
    text = plan(one)
    assert text.count("Aggregate") >= 2 and "Window" not in text
    hot = one.where("k = 1").first()
    assert (hot.source_row, hot.name, hot.copies) == (1, "n1", 6000)


def test_lookback_calendar_has_one_row_per_day(spark, snap):
    cal = T.lookback_calendar(snap.seasons, list(SEASONS))
    assert cal.groupBy("cutoff").count().where("count > 1").count() == 0


def test_partitions_grow_with_the_input(spark):
    """Rows of the study tables shrink far in a shuffle, so tasks are planned by few bytes and by order lines."""
    from pitlake import bindings as B

    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        B.Tables(spark, "/root/testdata/sf0.01").read("lineitem")
        few = int(spark.conf.get(names[2]))
        B.plan_partitions(spark, 36_000_000)
        assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and int(spark.conf.get(names[2])) == 720
        assert B._bytes(spark.conf.get(names[0])) <= 4 << 20 and B._bytes(spark.conf.get(names[1])) <= 32 << 20
        spark.conf.set(names[0], "1m")
        B.plan_partitions(spark, 1)
        assert B._bytes(spark.conf.get(names[0])) == 1 << 20
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_splits_of_a_file_are_small(spark):
    """A task of orders sorts all rows of its split, so splits stay small whatever the table's size."""
    from pitlake import bindings as B

    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(names[1], "128m")
        B.plan_partitions(spark, 1)
        assert B._bytes(spark.conf.get(names[1])) <= 4 << 20
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_leak_check_takes_the_table_that_is_there(spark):
    """The features of the unchanged history are not built a second time where they are landed."""
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (2, 1, 3.0)], "k int, d int, v double")
    later = spark.createDataFrame([(1, 9, 99.0)], "k int, d int, v double")
    calls = []

    def build(history):
        calls.append(history)
        return history.groupBy("k").agg(F.sum(F.when(F.col("d") < 2, F.col("v"))).alias("early"), F.max("v").alias("most"))

    built = build(rows)
    for columns, leaking in ((["early"], []), (["early", "most"], [1])):
        calls.clear()
        leaks = C.future_leaks(build, rows, later, ["k"], columns, built)
        assert len(calls) == 1 and [r.k for r in leaks.collect()] == leaking
        assert [r.k for r in C.future_leaks(build, rows, later, ["k"], columns).collect()] == leaking


def test_values_of_one_bucket_do_not_meet_in_one_task(spark):
    """Values packed into one bucket: no shuffle joins by bucket, cells are dealt out before they are copied, the median is exact."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    events = spark.range(4000).select(day.alias("d"), (1000.0 + F.col("id") * 37 % 4001 / 1000).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = A.trailing_median(events.select("d"), "d", events, "d", "v", 30)
        text = plan(found)
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
        assert text.count("REPARTITION_BY_NUM") >= 2
        got = {str(r.d): (r.median_value, r.n_events) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = [(r.d, r.v) for r in events.collect()]
    for d in sorted({d for d, _ in rows}):
        past = sorted(v for e, v in rows if 0 < (d - e).days <= 30)
        if past:
            want = (past[(len(past) - 1) // 2] + past[len(past) // 2]) / 2
            assert got[str(d)][1] == len(past) and abs(got[str(d)][0] - want) < 1e-9
        else:
            assert str(d) not in got


def test_a_row_group_of_orders_is_dealt_over_tasks(spark):
    """The orders of a file lie in one row group, which one task reads; collapsing the copies of moves is spread all the same."""
    from pitlake import bindings as B

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        moves = B.raw_moves(B.Tables(spark, "/root/testdata/sf0.01"))
        rows = [r["count"] for r in moves.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(rows) > 15_000 and max(rows) < 0.7 * sum(rows)
    finally:
        spark.conf.set(name, before)


def test_scoring_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Customers lie in one row group of one file; the rows to be scored are spread before their seasons are listed."""
    from pitlake import bindings as B

    monkeypatch.setattr(B, "LINES_PER_PARTITION", 200)
    t = B.Tables(spark, "/root/testdata/sf0.01")
    rows = [r["count"] for r in B.scoring_rows(t).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(rows) == t.read("customer").count() and len(rows) > 4 and max(rows) < 400


def test_lineups_are_shuffled_once(spark):
    """Their copies and their join with appearances need one shuffle, and no task of a file collapses its lines."""
    from pitlake import bindings as B

    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
             "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(n, None) for n in names]
    spark.conf.set(names[3], "-1")
    try:
        t = B.Tables(spark, "/root/testdata/sf0.001")
        rows = B.clean_lineup_rows(t)
        # Lines, orders, appearances by game and player, lineups.
        assert plan(A.enrich_history(B.appearances(t), rows)).count("Exchange ") == 4
        assert rows.count() == B.lineups(t).toPandas().drop_duplicates().shape[0]
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_fee_is_parsed_once(spark):
    """Class and amount of a fee name its text and number a dozen times; the plan trims and casts it once."""
    from pitlake.operators import cleaning as K

    names = ["player_id", "transfer_date", "transfer_season", "from_club_id", "to_club_id", "from_club_name", "to_club_name", "transfer_fee"]
    fees = ["5", " 7.5 ", "-", "", None, "inf", "-5", "abc", "0.0", "1d"]
    raw = spark.createDataFrame([(i, *("x" for _ in names[:-1]), f) for i, f in enumerate(fees)], "source_row long, " + ", ".join(f"{n} string" for n in names))
    typed = K.type_transfers(raw)
    text = typed._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("trim(transfer_fee") == 1 and text.count("as double") == 1
    paid = [(r.fee_class, r.fee_eur) for r in typed.orderBy("source_row").collect()]
    assert paid == [("paid", 5.0), ("paid", 7.5), *[("undisclosed", None)] * 3, *[("malformed", None)] * 3, ("zero_fee", None), ("malformed", None)]


def test_products_are_summed_as_matrices(spark):
    """Hundreds of sums per cycle are too many for compiled code; tasks add up matrices, and null groups stay apart."""
    from pitlake.operators import learn as M

    rows = [(1 if k % 3 else 2, float(k % 7), float(k % 5) + 1e6, 0.5 * k) for k in range(500)] + [(None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "cycle int, a double, b double, y double").repartition(5)
    found = M.grouped_moments(df, ["a", "b"], "y", "cycle")
    assert set(found.by_group) == {1, 2, None} and M.grouped_moments(df.limit(0), ["a"], "y", "cycle").by_group == {}
    for g, m in found.by_group.items():
        own = [[x - found.centre[c] for x, c in zip(r[1:], ("a", "b", "y"), strict=True)] for r in rows if r[0] == g]
        assert m.n == len(own) and m.columns == ["a", "b"]
        for i in range(3):
            assert abs(m.total[i] - sum(r[i] for r in own)) < 1e-6
            for j in range(3):
                want = sum(r[i] * r[j] for r in own)
                assert abs(m.cross[i, j] - want) <= 1e-9 * max(1.0, abs(want))
    plans = []
    original = type(df).mapInArrow
    try:
        type(df).mapInArrow = lambda self, *a, **k: plans.append(1) or original(self, *a, **k)
        M.grouped_moments(df, ["a", "b"], "y", "cycle")
    finally:
        type(df).mapInArrow = original
    assert plans
