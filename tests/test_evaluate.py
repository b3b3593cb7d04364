import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions import ranks as RK
from pitlake.operators import conformal as CF
from pitlake.operators import contracts as C
from pitlake.operators import evaluate as E
from pitlake.operators import facts as FX
from pitlake.operators import learn as M


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(8)
    y, p = rng.uniform(1, 99, 41), rng.uniform(1, 99, 41)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "i int, y double, p double")
    r = E.metrics(E.long_errors(df, ["i"], "y", {"m": (F.col("p"), F.log1p("p"))})).first()
    want = (np.abs(y - p).mean(), np.median(np.abs(y - p)), np.sqrt(((y - p) ** 2).mean()), np.abs(np.log1p(y) - np.log1p(p)).mean(),
            1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.allclose((r.mae, r.median_ae, r.rmse, r.log_mae, r.r2), want, rtol=1e-12) and r.rows == 41
    flat = df.withColumn("y", F.lit(5.0))
    assert E.metrics(E.long_errors(flat, ["i"], "y", {"m": (F.col("p"), F.log1p("p"))})).first().r2 is None


def test_baselines_use_train_only(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["GK", "MF", "FW"]), float(rng.randrange(1, 50))) for _ in range(31)]
    train = spark.createDataFrame(rows, "position string, fee double")
    test = spark.createDataFrame([(1, "MF"), (2, "DF"), (3, None)], "i int, position string")
    got = {r.i: r for r in E.with_baselines(test, train, "fee", "position").collect()}
    fees = [v for _, v in rows]
    for i, group in ((1, [v for k, v in rows if k == "MF"]), (2, []), (3, [])):
        assert got[i].train_median == np.median(fees) and math.isclose(got[i].train_mean, np.mean(fees))
        assert got[i].train_median_by_position == np.median(group or fees) and got[i].group_fallback == (not group)


def test_cluster_bootstrap(spark):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(25)}", rng.gauss(10, 3), rng.gauss(12, 3)) for _ in range(120)]
    df = spark.createDataFrame(rows, "player string, m double, b double")
    errors = {"m": F.col("m"), "b": F.col("b")}

    def run(frame, seed=3):
        return E.paired_cluster_bootstrap(frame, "player", errors, "m", 300, seed, 0.9).first()

    r = run(df)
    assert math.isclose(r.observed_delta, sum(m - b for _, m, b in rows) / len(rows))
    assert r.ci_low < r.observed_delta < r.ci_high and r.clusters == len({k for k, _, _ in rows}) and r.resampling_unit == "cluster"
    again = run(df.repartition(3))
    assert r.verdict == "lower" and np.allclose((again.ci_low, again.ci_high), (r.ci_low, r.ci_high), rtol=1e-12)
    assert abs(run(df, 4).ci_low - r.ci_low) > 1e-9
    light = E.paired_cluster_bootstrap(df, "player", errors, "m", 400, 3, 0.9, weights="poisson").first()
    assert light.verdict == "lower" and abs(light.ci_low - r.ci_low) < 0.6 and abs(light.ci_high - r.ci_high) < 0.6
    assert "Join" not in E._poisson_sums(E.cluster_sums(df, "player", errors), "player", ["m", "b"], 5, 3)._jdf.queryExecution().executedPlan().toString()
    swapped = E.paired_cluster_bootstrap(df.select("player", F.col("b").alias("m"), F.col("m").alias("b")), "player", errors, "m", 300, 3, 0.9).first()
    assert swapped.verdict == "higher" and math.isclose(swapped.ci_low, -r.ci_high)
    same = E.paired_cluster_bootstrap(df.withColumn("b", F.col("m")), "player", errors, "m", 50, 3, 0.9).first()
    assert (same.ci_low, same.ci_high, same.verdict) == (0.0, 0.0, "unclear")


def test_bootstrap_draws_equal_plain_counting(spark):
    """Every replicate draws as many clusters as there are; few of the draws are joined."""
    def mixed(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * E.MIX) & E.LOW32
        return x >> 16 ^ x

    n, reps, seed = 400, 60, 7
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("_rows"), (F.col("id") * 1.5).alias("e"))
    place = {r.k: r.i for r in RK.dense_index(df, "k", "i", "n").collect()}
    value = {i: 1.5 * k for k, i in place.items()}
    steps = E.thinned_steps(n)
    want, joined = {}, 0
    for rep in range(reps):
        counts = [sum(mixed(mixed(rep + seed * 65537) ^ i) >= s for s in steps) for i in range(n)]
        left = n - sum(counts)
        joined += left
        for j in range(1, left + 1):
            counts[mixed(mixed(rep + (seed + 1) * 65537) ^ j) * n >> 32] += 1
        want[rep] = (n, sum(c * value[i] for i, c in enumerate(counts)))
    got = {r["_rep"]: (r["_n"], r.e) for r in E._multinomial_sums(df, "k", ["e"], reps, seed).collect()}
    assert set(got) == set(want) and all(got[r][0] == n and math.isclose(got[r][1], want[r][1]) for r in want)
    assert joined / reps < (E.MARGIN + 3) * math.sqrt(n)
    means = np.array([v[1] / n for v in want.values()])
    spread = np.std([1.5 * k for k in range(n)]) / math.sqrt(n)
    assert abs(means.mean() - 1.5 * (n - 1) / 2) < 5 * spread / math.sqrt(reps) and 0.7 < means.std() / spread < 1.35
    assert E._multinomial_sums(df.limit(1), "k", ["e"], 3, 1).where("_n <> 1").isEmpty()


def test_bootstrap_draws_are_not_broadcast(spark):
    """Draws grow with replicates and clusters, though Spark takes them for a row per replicate."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("_rows"), F.col("id").alias("e"))
    found = E._multinomial_sums(df, "k", ["e"], 20, 1)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_poisson_counts_equal_the_steps(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("u"))
    df = df.unionByName(spark.createDataFrame([("0" * 32,), ("f" * 32,)], "u string"))
    rows = df.withColumn("w", E.poisson_count(F.col("u"))).collect()
    assert all(r.w == sum(int(r.u[:13], 16) / float(16**13) >= c for c in E.poisson_steps()) for r in rows)
    assert {0, 1, 2, 3, 4, 5} <= {r.w for r in rows}


def test_worst_k_ties(spark):
    df = spark.createDataFrame([("m", 3.0), ("q", 8.0), ("c", 8.0), ("z", 8.0), ("a", None)], "k string, e double")
    assert [r.k for r in E.worst_k(df, "e", "k", 2).collect()] == ["c", "q"]


def test_selection_counts_noise_as_a_tie(spark):
    rows = [("late", 5, 0.412300004, 0.07, True), ("early", 2, 0.41230001, 0.07, True), ("failed", 0, 0.3, 0.07, False), ("worse", 1, 0.4125, 0.01, True)]
    df = spark.createDataFrame(rows, "name string, o int, mean_log_mae double, std_log_mae double, eligible boolean")
    assert M.pick_best(df, ["name"], ["o"]).first().name == "early"
    assert M.pick_best(df.withColumn("o", -F.col("o")), ["name"], ["o"]).first().name == "late"


def test_conformal_equals_order_statistics(spark):
    rng = random.Random(2)
    scores = sorted(rng.random() for _ in range(23))
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    q = {r.level: r.q_log for r in CF.conformal_quantile(df, "s", [0.5, 0.9, 0.97]).collect()}
    for level, value in q.items():
        k = math.ceil(24 * level)
        assert value == (scores[k - 1] if k <= 23 else float("inf"))
    for log, width in ((2.0, 0.7), (0.2, 3.0)):
        lo, hi = spark.range(1).select(*CF.interval(F.lit(log), F.lit(width))).first()
        assert math.isclose(lo, max(0.0, math.expm1(log - width)), abs_tol=1e-12) and math.isclose(hi, math.expm1(log + width))
    res = [rng.gauss(0, 2) for _ in range(50)] + [1.5, -1.5]
    c = CF.coverage(spark.createDataFrame([(r,) for r in res], "r double"), F.col("r"), F.lit(1.5)).first()
    want = [sum(f(r) for r in res) / 52 for f in (lambda r: abs(r) <= 1.5, lambda r: r > 1.5, lambda r: r < -1.5)]
    assert np.allclose([c.coverage, c.share_above_upper, c.share_below_lower], want)


@pytest.mark.parametrize("kind", ["mixed", "hot", "narrow"])
def test_exact_quantiles_match_percentile(spark, kind):
    rng = random.Random(11)
    pick = [lambda: rng.gauss(0, 1), lambda: 1e6 * rng.random(), lambda: 0.0, lambda: -1e-9 * rng.random()]
    pick = [lambda: 1.7e9 + rng.randrange(100_000) / 2] if kind == "narrow" else pick
    rows = [(rng.choice("xyz"), 7.25 if kind == "hot" and i % 3 else rng.choice(pick)()) for i in range(999)]
    df = spark.createDataFrame([*rows, ("x", None)], "g string, v double")
    got = {r.g: r for r in RK.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.9}, ["g"]).collect()}
    for g in "xyz":
        v = [x for k, x in rows if k == g]
        want = np.quantile(v, [0.25, 0.5, 0.9])
        assert np.allclose([got[g].a, got[g].b, got[g].c], want, rtol=1e-12, atol=1e-15)
        assert got[g].n_values == len(v)


@pytest.mark.parametrize("n,k", [(1000, 6), (17, 4), (3, 6)])
def test_bands_have_array_split_sizes_even_with_a_hot_value(spark, n, k):
    rows = [(f"k{i}", 5.0 if i % 3 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, prediction double")
    got = RK.equal_count_bands(df, "prediction", "key", k).collect()
    sizes = [len(x) for x in np.array_split(np.arange(n), min(k, n))]
    counts = [sum(r.band == b + 1 for r in got) for b in range(len(sizes))]
    assert counts == sizes
    tops = [max((r.prediction for r in got if r.band == b + 1)) for b in range(len(sizes))]
    lows = [min((r.prediction for r in got if r.band == b + 1)) for b in range(len(sizes))]
    assert all(tops[i] <= lows[i + 1] for i in range(len(sizes) - 1))


def test_dense_index(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    got = [r.i for r in RK.dense_index(df, "k", "i", "n").orderBy("i").collect()]
    assert got == list(range(5000))
    assert RK.dense_index(df, "k", "i", "n").select("n").distinct().first().n == 5000


def _panel(spark, n=300):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(50, 10, n), rng.normal(0, 1, n)
    pos = rng.choice(["GK", "DF", "MF", "FW"], n)
    y = 12 + 0.03 * x1 - 0.4 * x2 + (pos == "FW") * 0.5 + rng.normal(0, 0.3, n)
    cyc = np.arange(n) * 5 // n + 2015
    rows = [(float(a), float(b), str(p), float(v), int(c)) for a, b, p, v, c in zip(x1, x2, pos, y, cyc, strict=True)]
    df = spark.createDataFrame(rows, "minutes double, goals double, position string, label double, cycle int")
    return M.with_one_hot(df, "position"), (x1, x2, pos, y, cyc)


def test_linear_fits_match_direct_solutions(spark):
    df, (x1, x2, pos, y, cyc) = _panel(spark)
    flags = list(M.one_hot("position"))
    stats = M.grouped_moments(df, ["minutes", "goals", *flags], "label", "cycle")
    z = np.column_stack([(v - v.mean()) / v.std() for v in (x1, x2)])
    h = np.column_stack([(pos == p).astype(float) for p in ("GK", "DF", "MF", "FW")])
    x = np.column_stack([z, h])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    ols = M.final_fit(stats, M.Candidate("linear"), ["minutes", "goals"], flags, "label")
    want = np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert np.allclose(ols.coef, want, atol=1e-8) and abs(ols.coef[2:].sum()) < 1e-8
    assert abs(ols.intercept - (y.mean() - want @ x.mean(axis=0))) < 1e-8
    ridge = M.final_fit(stats, M.Candidate("ridge", 10.0), ["minutes", "goals"], flags, "label")
    assert np.allclose(ridge.coef, np.linalg.solve(xc.T @ xc + 10 * np.eye(6), xc.T @ yc), atol=1e-8)
    net = M.final_fit(stats, M.Candidate("elastic_net", 0.1, 0.5), ["minutes", "goals"], flags, "label")
    grad = xc.T @ (yc - xc @ net.coef) / len(y) - 0.05 * net.coef
    on = np.abs(net.coef) > 0
    assert np.allclose(grad[on], 0.05 * np.sign(net.coef[on]), atol=1e-7) and (np.abs(grad[~on]) <= 0.05 + 1e-7).all()


def test_mllib_parity(spark):
    df, (x1, x2, pos, y, cyc) = _panel(spark)
    z = M.standardise(
        df.withColumn("g", F.lit(0)), M.training_moments(df, ["minutes", "goals"]).withColumn("g", F.lit(0)),
        ["minutes", "goals"], "g",
    )
    stats = M.grouped_moments(df, ["minutes", "goals"], "label", "cycle")
    for c in (M.Candidate("linear"), M.Candidate("ridge", 10.0), M.Candidate("elastic_net", 0.1, 0.5)):
        ours = M.final_fit(stats, c, ["minutes", "goals"], [], "label")
        theirs = M.fit_mllib(z, ["z_minutes", "z_goals"], "label", c, len(y), float(y.std()))
        assert np.allclose(ours.coef, theirs.coefficients.toArray(), atol=1e-6), c.name
        assert abs(ours.intercept - theirs.intercept) < 1e-6


def test_moment_rows_keep_the_moments():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (50, 4)) @ rng.normal(0, 1, (4, 4))
    x[:, 3] = x[:, 0] + x[:, 1]  # rank deficient
    full = np.cov(x.T, bias=True)
    rows = M.moment_rows(full[:3, :3], full[:3, 3], full[3, 3])
    assert np.allclose(rows.T @ rows / len(rows), full) and np.allclose(rows.mean(axis=0), 0)


def test_every_fit_is_optimal_on_the_rows(spark):
    df, _ = _panel(spark)
    flags = list(M.one_hot("position"))
    scores, cv, _ = M.cross_validate(df, {"both": ["minutes", "goals"], "one": ["minutes"]}, flags, "label", "cycle", 2)
    assert scores.where("not eligible").isEmpty()
    gaps = M.optimality(df.repartition(3), cv, "label", "cycle").collect()
    assert len(gaps) == 2 * 14 * 2 and max(r.gap for r in gaps) < 1e-7
    nets = [f.coef for cand in cv.fits["both"] for f in cand if f.candidate.family == "elastic_net"]
    assert any((w == 0).any() and (w != 0).any() for w in nets)
    cv.fits["both"][5][0].coef[0] += 0.01  # a wrong fit is found
    bad = M.optimality(df, cv, "label", "cycle").where("gap > 1e-4").collect()
    assert [(r.variant, r.grid_order, r.fold) for r in bad] == [("both", 5, 0)]


def test_a_penalty_can_win_and_is_what_is_selected(spark):
    """Few rows and many idle inputs: the penalised fits predict later cycles better than least squares."""
    rng = np.random.default_rng(12)
    n, p = 120, 20
    x = rng.normal(0, 1, (n, p))
    y = 2.0 * x[:, 0] + rng.normal(0, 2.0, n)
    names = [f"x{i}" for i in range(p)]
    rows = [(*map(float, r), float(v), int(i * 4 // n)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label double, cycle int")
    scores, cv, _ = M.cross_validate(df, {"v": names}, [], "label", "cycle", 3)
    pick = M.select_models(scores)
    table = {}
    for r in scores.collect():
        table.setdefault((r.family, r.grid_order), []).append(r.log_mae)
    key = {k: (round(float(np.mean(v)), 4), round(float(np.std(v)), 4), k[1]) for k, v in table.items()}
    assert pick.selected == "elastic_net" == min(key, key=key.get)[0]
    assert pick.finalists == {f: min((k for k in key if k[0] == f), key=key.get)[1] for f in M.FAMILIES}
    one = cv.only("v", pick.grid_order)
    assert one.fits["v"][0][0].candidate == M.linear_grid()[pick.grid_order]
    with pytest.raises(RuntimeError, match="ridge"):
        M.select_models(scores.where("family <> 'ridge'"))


def test_cross_validation_scores_match_numpy(spark):
    df, (x1, x2, pos, y, cyc) = _panel(spark)
    scores, cv, _ = M.cross_validate(
        df, {"v": ["minutes", "goals"]}, [], "label", "cycle", 2, [M.Candidate("linear"), M.Candidate("ridge", 100.0)]
    )
    got = {(r.grid_order, r.fold): (r.log_mae, r.rows) for r in scores.collect()}
    for fold, val in enumerate((2018, 2019)):
        tr, va = cyc < val, cyc == val
        m, s = np.array([x1[tr].mean(), x2[tr].mean()]), np.array([x1[tr].std(), x2[tr].std()])
        zt, zv = (np.column_stack([x1[k], x2[k]]) for k in (tr, va))
        zt, zv = (zt - m) / s, (zv - m) / s
        for order, alpha in ((0, 0.0), (1, 100.0)):
            w = np.linalg.solve(zt.T @ zt + alpha * np.eye(2), zt.T @ (y[tr] - y[tr].mean()))
            want = np.abs(y[va] - y[tr].mean() - zv @ w).mean()
            assert abs(got[(order, fold)][0] - want) < 1e-9 and got[(order, fold)][1] == va.sum()
    oof = CF.out_of_fold(df, cv, "v", 0, "cycle", "label")
    back = {r.fold: r.m for r in oof.groupBy("fold").agg(F.avg(F.abs("oof_residual")).alias("m")).collect()}
    assert all(abs(back[f] - got[(0, f)][0]) < 1e-9 for f in (0, 1))


def test_forbidden_inputs():
    with pytest.raises(AssertionError):
        M.check_inputs(["goals", "market_value_eur"])
    assert len(M.linear_grid()) == 14 and len(M.variants()) == 6


def test_unseen_category_is_all_zero(spark):
    df = spark.createDataFrame([("GK",), ("??",), (None,)], "position string")
    rows = M.with_one_hot(df, "position").select(*M.one_hot("position")).collect()
    assert [sum(r) for r in rows] == [1.0, 0.0, 0.0]


def test_compression_constant_prediction(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 1.0)], "k string, fee double, g double")
    r = CF.compression(df, "fee", "g", "k").first()
    assert r.calibration_slope is None and r.largest_label == 20.0 and r.top_decile_rows == 1


def test_cross_run_check(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.5), (4, 1.0)], "k int, v double")
    r = C.count_differences(a, b, "k", {"v": 1e-6}).first()
    assert (r.matched, r.only_first, r.only_second, r.off_v) == (2, 1, 1, 1)


def test_largest_labels_join_touches_top_only(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), float(i) / 2, abs(i / 2.0)) for i in range(40)],
                               "k string, fee double, prediction double, abs_error double")
    bounds = df.select("k", F.lit(0.0).alias("lower"), F.lit(30.0).alias("upper"))
    out = FX.largest_labels(df, bounds, "fee", "k", 25, 5).collect()
    assert len(out) == 25 and sum(r.in_worst for r in out) == 5 and sum(r.covered for r in out) == 16


@pytest.mark.parametrize("column", ["minutes", "label"])
@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_fitting_and_scoring_fail_on_non_finite_rows(spark, column, bad):
    df, _ = _panel(spark, 60)
    dirty = df.withColumn(column, F.when((F.col("cycle") == 2016) & (F.col("position") == "GK"), F.lit(bad).cast("double")).otherwise(F.col(column))).repartition(8)
    for fit in (
        lambda: M.grouped_moments(dirty, ["minutes", "goals"], "label", "cycle"),
        lambda: M.cross_validate(dirty, {"v": ["minutes"]}, [], "label", "cycle", 2, [M.Candidate("linear")])[0].collect(),
    ):
        with pytest.raises(Exception, match="non-finite input"):
            fit()
    _, cv, _ = M.cross_validate(df, {"v": ["minutes"]}, [], "label", "cycle", 4, [M.Candidate("linear")])
    with pytest.raises(Exception, match="non-finite input"):
        M.score_folds(dirty, cv, "label", "cycle").collect()


def test_scores_do_not_depend_on_partitions(spark):
    df, _ = _panel(spark, 90)
    got = [
        {(r.fold, r.grid_order): round(r.log_mae, 12) for r in M.cross_validate(d, {"v": ["minutes"]}, [], "label", "cycle", 2)[0].collect()}
        for d in (df.repartition(1), df.repartition(7))
    ]
    assert got[0] == got[1]
