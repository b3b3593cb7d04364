"""What is landed step by step: disk is given back, and the columns of models equal those of the full composition."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pitlake import bindings as B
from pitlake.functions.landing import CLEANUP, discard, is_landed, land, shared_folder
from pitlake.operators import asof as A
from pitlake.operators import cleaning as K
from pitlake.operators import learn as M
from pitlake.plans import study as ST

FOLDER = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirsString() for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}


@pytest.fixture
def settings(spark):
    """Reading order lines changes the session's settings of partitions."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_shuffles_of_a_landed_table_go(spark):
    rows = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before, kept = shuffle_files(spark), spark.conf.get(CLEANUP)
    table = land(rows.join(rows.withColumnRenamed("n", "m"), "k"), "joined")
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP) == kept
    assert table.count() == 5000 and is_landed(table) and not is_landed(table.select("k"))
    folder = table.landed_at.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)


def test_moves_without_names_are_the_same_moves(spark, settings):
    raw = B.raw_moves(B.Tables(spark, FOLDER)).withColumn("source_row", F.col("source_row") % 1009)  # copies of other keys tie
    full, slim = K.clean_transfers(raw), K.clean_transfers(raw, names=False)
    assert rows_of(slim) == rows_of(full.select(slim.columns)) and "from_club_name" not in slim.columns
    text = slim._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text


def test_windows_are_looked_up_in_one_pass(spark):
    """Rows are shuffled once, and the history once by entity and day and once by entity."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int"))
        history = spark.range(3000).select((F.col("id") % 7).alias("k"), day.alias("d"), F.col("id").cast("double").alias("v"))
        rows = spark.range(200).select(
            F.col("id").alias("r"), (F.col("id") % 9).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("s"),
            F.when(F.col("id") % 13 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 95).cast("int"))).alias("e"))
        found = A.window_sums(rows, history, "k", "s", "e", "d", {"v": F.col("v")})
        text = found._jdf.queryExecution().executedPlan().toString()
        assert text.count("+- Exchange") + text.count(":- Exchange") <= 5, text
        kept = history.collect()
        for r in found.collect():
            want = None if r.e is None or r.s > r.e else sum(h.v for h in kept if h.k == r.k and r.s <= h.d < r.e)
            assert r.v == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_columns_equal_the_full_composition(spark, settings):
    """The landed model and enriched tables have the rows that the lazy steps over all columns give."""
    t = B.Tables(spark, FOLDER)
    feats, i = ST.landed_features(t)
    assert rows_of(ST.landed_model(t)) == rows_of(feats.select(*ST.MODEL_COLUMNS))
    enriched = ST.landed_enriched(t)
    comps = B.competitions(t)
    others = A.other_leagues(comps, comps.where("in_study").select("competition_id"))
    out = A.exposure_columns(feats, i.games, i.appearances, i.expected).withColumn("cycle_trend", A.cycle_trend())
    out = out.join(ST.landed_price_level(feats, i, 1), "transfer_date", "left")
    points = A.with_points(i.appearances, i.games)
    out = A.context_columns(out, i.seasons, points, B.appearance_rows(t, B.all_games(t)), others, [n for n in range(25) if n % 5 == 3])
    out = M.with_one_hot(out, "position")
    assert enriched.count() > 100 and rows_of(enriched) == rows_of(out.select(enriched.columns))


def test_nothing_but_the_result_stays_landed(spark, settings):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    ST.landed_enriched(B.Tables(spark, FOLDER))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert "enriched" in left and not left & {"appearances", "moves", "labels", "daily", "features"}
