import numpy as np
import pytest

from pitlake.operators import boosting as GB

COLUMNS = ["goals", "minutes", "age"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = np.column_stack([rng.integers(0, 12, n), rng.uniform(0, 90, n), rng.uniform(17, 38, n)]).astype(float)
    y = np.sin(x[:, 0]) + 0.02 * x[:, 1] - 0.05 * x[:, 2] + rng.normal(0, 0.1, n)
    cycle = np.arange(n) * 4 // n
    rows = [(*map(float, a), float(b), int(c)) for a, b, c in zip(x, y, cycle, strict=True)]
    return spark.createDataFrame(rows, "goals double, minutes double, age double, label double, cycle int").coalesce(1), x, y, cycle


def test_grid():
    assert [s.name for s in GB.grid()][:3] == [
        "gbm(max_depth=2, min_leaf=10, rounds=150)", "gbm(max_depth=2, min_leaf=10, rounds=300)", "gbm(max_depth=2, min_leaf=20, rounds=150)"]
    assert len(GB.grid()) == 8 and [s.order for s in GB.grid()] == list(range(8))
    with pytest.raises(AssertionError):
        GB.assembled(None, ["goals", "fee_eur"], "label")


def test_stages_equal_fits_of_their_own(spark, panel, tmp_path):
    df, x, y, cycle = panel
    shapes = GB.grid((2,), (10,), (4, 9))
    out = {(r.grid_order, r.fold): r for r in GB.cross_validate(df, COLUMNS, "label", "cycle", 2, shapes, str(tmp_path)).collect()}
    assert len(out) == 4 and all(r.eligible for r in out.values())
    rows = GB.assembled(df, COLUMNS, "label", ["cycle"])
    for order, rounds in ((0, 4), (1, 9)):
        for fold, val in ((0, 2), (1, 3)):
            alone = GB.fit(rows.where(f"cycle < {val}"), 2, 10, rounds)
            got = np.array([r.prediction for r in alone.transform(rows.where(f"cycle = {val}")).select("prediction").collect()])
            r = out[order, fold]
            assert r.rows == (cycle == val).sum() and abs(r.log_mae - np.abs(got - y[cycle == val]).mean()) < 1e-9
            trees = GB.ensemble(spark, f"{tmp_path}/depth=2-leaf=10-cycle={val}/trees")
            first = GB.Ensemble(trees.trees[:rounds], trees.weights[:rounds], trees.thresholds)
            assert np.allclose(first.predict(x[cycle == val]), got, atol=1e-9)


def test_finished_fits_are_not_repeated(spark, panel, tmp_path, monkeypatch):
    df, *_ = panel
    shapes = GB.grid((2,), (10,), (2, 3))
    want = sorted(map(tuple, GB.cross_validate(df, COLUMNS, "label", "cycle", 2, shapes, str(tmp_path)).collect()))
    fits = []
    monkeypatch.setattr(GB, "fit", lambda *a, fit=GB.fit, **k: fits.append(a) or fit(*a, **k))
    lost = tmp_path / "depth=2-leaf=10-cycle=3" / "scores"
    for f in lost.iterdir():
        f.unlink()
    again = sorted(map(tuple, GB.cross_validate(df, COLUMNS, "label", "cycle", 2, shapes, str(tmp_path)).collect()))
    assert again == want and len(fits) == 1
    with pytest.raises(ValueError):
        GB.cross_validate(df.where("cycle < 2"), COLUMNS, "label", "cycle", 2, shapes)


def test_audit_equals_brute_force(spark, panel, tmp_path):
    df, x, *_ = panel
    rows = GB.assembled(df, COLUMNS, "label")
    GB.fit(rows, 2, 10, 6).write().save(str(tmp_path / "trees"))
    trees = GB.ensemble(spark, str(tmp_path / "trees"))
    got = {r.feature: r for r in GB.monotonicity_audit(rows.repartition(3), trees, COLUMNS, {"goals": 1, "age": -1, "minutes": 0}).collect()}
    assert set(got) == {"goals", "age"} and got["goals"].violations > 0
    for j, c, sign in ((0, "goals", 1), (2, "age", -1)):
        cuts = trees.thresholds.get(j, np.zeros(0))
        points = np.concatenate([cuts, cuts + 1e-7, [-1e9, 1e9]])  # both sides of every cut
        moves = violations = hit = 0
        largest = 0.0
        for row in x:
            probes = np.repeat(row[None, :], len(points), axis=0)
            probes[:, j] = np.sort(points)
            step = sign * np.diff(trees.predict(probes))
            moves += (abs(step) > 1e-12).sum()
            violations += (step < -1e-12).sum()
            hit += (step < -1e-12).any()
            largest = max(largest, -step.min())
        r = got[c]
        assert (r.sign, r.thresholds, r.rows, r.moves, r.violations, r.violating_rows) == (sign, len(cuts), len(x), moves, violations, hit)
        assert abs(r.largest - (largest if violations else 0)) < 1e-12
    assert GB.monotonicity_audit(rows.limit(0), trees, COLUMNS).where("violations > 0").isEmpty()


def test_models_grow_together_and_equal_mllib(spark, panel):
    """Several models cost the jobs of one, and each is the one that MLlib fits."""
    from pyspark.ml.regression import GBTRegressor

    df, *_ = panel
    rows = GB.assembled(df, COLUMNS, "label", ["cycle"]).cache()
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    shapes = [(2, 10, 11, 2), (3, 20, 9, 2), (2, 10, 11, 4), (3, 20, 11, 3)]
    models = GB.fit(rows, *([s[k] for s in shapes] for k in range(3)), before=[("cycle", s[3]) for s in shapes])
    assert scheduler.nextJobId() - before <= 11 * 3 + 20
    for (depth, leaf, rounds, limit), model in zip(shapes, models, strict=True):
        own = rows.where(f"cycle < {limit}")
        alone = GBTRegressor(featuresCol="x", labelCol="y", maxDepth=depth, minInstancesPerNode=leaf, maxIter=rounds, stepSize=GB.STEP, seed=42).fit(own)
        want = np.array([r[0] for r in alone.transform(rows).select("prediction").collect()])
        got = np.array([r[0] for r in model.transform(rows).select("prediction").collect()])
        assert len(model.trees) == rounds and np.abs(want - got).max() < 1e-9
    with pytest.raises(ValueError):
        GB.fit(rows.limit(0), 2, 10, 2)


def test_blocks_and_partitions_do_not_matter(spark, panel, monkeypatch):
    df, *_ = panel
    rows = GB.assembled(df, COLUMNS, "label")
    one = GB.fit(rows, 3, 10, 9)
    monkeypatch.setattr(GB, "BLOCK_ROWS", 70)  # several tasks, and lineage is cut within the run
    monkeypatch.setattr(GB, "CUT_EVERY", 1)
    many = GB.fit(rows.repartition(5), 3, 10, 9)
    x = np.array([r[0].toArray() for r in rows.select("x").collect()])
    assert np.allclose(one.predict(x), many.predict(x), atol=1e-9)


def test_audit_reads_only_trees_that_split_on_the_input(panel):
    _, x, *_ = panel
    trees = [(0, 3.0, 1.0, (2, 20.0, 0.5, 2.0)), (1, 40.0, 0.0, 1.0), (2, 25.0, 4.0, (0, 5.0, 1.0, 3.0))]
    model = GB.Ensemble(trees, [1.0, 0.05, 0.05], {0: np.array([3.0, 5.0]), 1: np.array([40.0]), 2: np.array([20.0, 25.0])})
    for j, many in ((0, 2), (1, 1), (2, 2)):
        points = np.append(model.thresholds[j], np.inf)
        assert len(model.using(j).trees) == many
        assert np.allclose(np.diff(model.predict(x, j, points)), np.diff(model.using(j).predict(x, j, points)), atol=1e-12)


def test_rows_of_one_cell_are_kept_once(spark, monkeypatch):
    """Rounds read one entry per combination of bins, not the rows; more inputs than one packed key holds stay apart."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (3000, 14)).astype(float)
    x[:, 2:13] = 0.0
    y = x[:, 0] - 2 * x[:, 13] + rng.normal(0, 0.1, 3000)
    names = [f"f{j}" for j in range(14)]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "label"]))
    rows = GB.assembled(df, names, "label")
    kept = []
    monkeypatch.setattr(GB, "_blocks", lambda cells, *a, made=GB._blocks: kept.append(cells) or made(cells, *a))
    model = GB.fit(rows, 2, 10, 40)
    found = kept[0].toPandas()
    assert len(found) == 27 and found["rows"].sum() == 3000 and abs(found["label"].sum() - y.sum()) < 1e-8
    assert {j for t in model.trees for j in GB._thresholds([t])} == {0, 1, 13} or np.abs(model.predict(x) - y).mean() < 0.3
