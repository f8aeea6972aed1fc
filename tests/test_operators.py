"""Hand values, brute force, refusals and poison pairs for the analytics operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import axes, climatology, fit, folds, mask, metrics, spatial, vectors

SF = "/root/testdata/sf0.001"


def frames(spark, rows):
    return spark.createDataFrame(rows, "cube long, acq_idx int, day_idx int")


def test_index_by_hand(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.4, 0.1, True), (0.3, 0.1, True), (0.5, 0.25, True), (0.1, 0.3, False), (0.1, -0.1, True), (nan, 0.1, True), (None, 0.1, True)], "a double, b double, ok boolean")
    got = [r.v for r in df.select(mask.ndvi("a", "b", "ok").alias("v")).collect()]
    assert got[:3] == pytest.approx([0.6, 0.5, 1 / 3], abs=1e-6) and got[3:] == [None] * 4


def test_clear_selection_is_strict_and_may_only_be_tightened(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "clear_frac double")
    assert mask.select_clear(df).count() == 1
    with pytest.raises(ValueError):
        mask.select_clear(df, 0.4)


def test_empty_steps_and_fallback(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (2, None, float("nan"))], "k int, a double, b double")
    assert [r.k for r in mask.drop_empty_steps(df, ["k"], ["a", "b"]).collect()] == [1, 1]
    x = spark.createDataFrame([(0, 9), (None, 4), (None, None)], "m int, s int")
    valid, source = mask.fallback_mask([("m", (0,)), ("s", (4, 5))])
    assert [tuple(r) for r in x.select(valid, source).collect()] == [(True, "m"), (True, "s"), (False, "none")]


def test_backward_window_is_clipped_to_the_start(spark):
    s = spark.createDataFrame([(1, d, float(d)) for d in range(10)], "cube long, day int, value double")
    got = {r.day: (r["mean"], r.days_available) for r in axes.backward_windows(s, s, 3, 5).collect()}
    assert got[0] == (0.0, 1) and got[5] == (0.0, 1) and got[6] == (0.5, 2) and got[9] == (3.0, 3)


def test_asof_ties_go_to_the_earlier_frame(spark):
    f = frames(spark, [(1, 0, 0), (1, 1, 8), (1, 2, 12), (1, 3, 40), (2, 0, 0)])
    s = spark.createDataFrame([(10, 3), (30, 3)], "delta int, tol int")
    got = {(r.cube, r.acq_idx, r.delta): r.acq_target for r in axes.horizon_rows(f, s).collect()}
    assert got == {(1, 0, 10): 1, (1, 1, 30): 3, (1, 2, 30): 3}
    assert {r.acq_idx for r in axes.horizon_rows(f, s, context=2).collect()} == {1, 2}


def test_common_delta_is_the_difference_of_common_levels(spark):
    f = frames(spark, [(1, 0, 0), (1, 1, 5), (1, 2, 9)])
    px = spark.createDataFrame([(1, 0, 0, 0.1), (1, 0, 1, 0.5), (1, 1, 1, 0.7), (1, 1, 2, 0.9), (1, 2, 0, 0.3)], "cube long, acq_idx int, cell int, ndvi float")
    a, b = axes.common_delta(axes.consecutive_pairs(f), px, ["cell"]).orderBy("acq_idx_a").collect()
    assert a.n_common == 1 and a.delta_mean == pytest.approx(0.2, abs=1e-6) and a.level_b - a.level_a == pytest.approx(a.delta_mean, abs=1e-12)
    assert b.n_common == 0 and b.delta_mean is None


def test_fold_tables_are_safe_and_refuse(spark):
    rows = spark.createDataFrame([(c, a, 2018 + c % 3, dt.date(2018 + c % 3, 1 + a, 1), c % 4) for c in range(12) for a in range(1 + c % 5)], "cube long, acq_idx int, year int, ts date, tile int")
    tables = [folds.group_folds(rows, "cube", 3), folds.group_folds(rows, "tile", 5, clamp=True), folds.year_folds(rows), folds.crossed_folds(rows, 3), folds.temporal_folds(rows, "2019-02-15")]
    for t in tables:
        assert folds.leakage(t).count() == 0 and t.groupBy("cube", "acq_idx", "fold").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        folds.group_folds(rows, "cube", 13)
    with pytest.raises(folds.SingleYearError):
        folds.year_folds(rows.where("year = 2018"))
    with pytest.raises(folds.LeakageError):
        folds.year_folds(rows.withColumn("year", F.col("year") + F.col("acq_idx")))
    poisoned = tables[0].unionByName(tables[0].where("side = 'test'").limit(1).withColumn("side", F.lit("train")))
    assert folds.leakage(poisoned).count() == 1


def test_balanced_assignment_by_hand(spark):
    rows = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in folds.balanced_groups(rows, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def harmonic_data(seed=0, n=300):
    rng = np.random.default_rng(seed)
    return [(int(c), int(d), float(0.3 * math.sin(2 * math.pi * d / 365.25) + rng.normal(0, 0.05))) for c, d in zip(rng.integers(0, 10, n), rng.integers(1, 366, n))]


def harmonic(spark, data):
    rows = spark.createDataFrame(data, "cube long, doy int, y double")
    by = rows.select("cube").distinct().withColumn("fold", (F.col("cube") % 5).cast("int"))
    return {r.fold: r.coef for r in fit.fit_by_fold(rows, by, fit.harmonic_design("doy", 2), "y", "doy", 5, ["cube"]).collect()}


def test_harmonic_fit_equals_least_squares_and_ignores_the_held_out(spark):
    data = harmonic_data()
    got = harmonic(spark, data)
    design = lambda d: [1.0] + [f(2 * math.pi / 365.25 * k * d) for k in (1, 2) for f in (math.cos, math.sin)]
    for f, coef in got.items():
        train = [r for r in data if r[0] % 5 != f]
        want = np.linalg.lstsq(np.array([design(d) for _, d, _ in train]), np.array([y for *_, y in train]), rcond=None)[0]
        assert coef == pytest.approx(want, abs=1e-9)
    poisoned = harmonic(spark, [(c, d, y + 100 * (c % 5 == 0)) for c, d, y in data])
    assert poisoned[0] == pytest.approx(got[0], abs=1e-6) and abs(poisoned[1][0] - got[1][0]) > 1
    assert harmonic(spark, [(c, 7 + c % 2, y) for c, _, y in data])[0] is None


def test_ridge_equals_direct_solve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 2, (200, 5))
    y = x @ [1, 0, -2, 0.5, 0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(i % 4, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "fold int, v array<double>, y double")
    path = fit.ridge_path(df, "v", "y", "fold", [0.1, 10.0])
    for r in path.collect():
        tr = np.arange(200) % 4 != r.fold
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        coef = np.linalg.solve(z.T @ z + r.alpha * np.eye(5), z.T @ (y[tr] - y[tr].mean())) / s
        pred = (x[~tr] - m) @ coef + y[tr].mean()
        assert r.coef == pytest.approx(coef, abs=1e-8)
        assert r.r2 == pytest.approx(1 - ((y[~tr] - pred) ** 2).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum(), abs=1e-8)
    assert fit.best_alpha(path).first().alpha == 0.1


def test_climatology_leaves_the_year_out(spark):
    rows = [(1, dt.date(y, 3, 1) + dt.timedelta(15 * i), float(y - 2000 + i) if i != 3 else None) for y in (2018, 2019, 2020) for i in range(8)]
    df = spark.createDataFrame(rows, "k int, ts date, value double")
    base = {(r.excluded, r.doy): r.clim for r in climatology.leave_year_out(df, ["k"]).collect()}
    poison = df.withColumn("value", F.when(F.year("ts") == 2019, F.col("value") + 1000).otherwise(F.col("value")))
    moved = {(r.excluded, r.doy): r.clim for r in climatology.leave_year_out(poison, ["k"]).collect()}
    assert all(moved[k] == base[k] for k in base if k[0] == 2019) and all(moved[k] >= base[k] for k in base) and any(moved[k] > base[k] + 100 for k in base if k[0] == 2018)
    assert climatology.leave_year_out(df.where(F.year("ts") == 2018), ["k"]).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(1, float(i), float(i) + (0.5 if i % 2 else -0.5)) for i in range(10)] + [(2, 1.0, 1.0)] * 9, "k int, y double, p double")
    got = {r.k: r.r2 for r in df.groupBy("k").agg(metrics.r2("y", "p").alias("r2")).collect()}
    assert got == {1: pytest.approx(1 - 2.5 / 82.5), 2: None}
    rho = {r.k: r.rho for r in metrics.spearman(df, ["k"], "y", "p").collect()}
    assert rho[2] is None and 0.9 < rho[1] < 1
    c = metrics.class_scores(spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (0, "b", "b")], "k int, y string, p string"), ["k"], "y", "p").first()
    assert c.balanced_accuracy == 0.75 and c.macro_f1 == pytest.approx(2 / 3)


def test_controls(spark):
    rows = [("a", 0, "m", 0.5, False), ("a", 0, "c", 0.2, True), ("a", 1, "m", 0.6, False)]
    s = spark.createDataFrame(rows, "mode string, fold int, model string, r2 double, is_control boolean")
    assert sorted((r.fold, r.margin) for r in metrics.margins(s, ["mode", "fold"], "r2").collect() if r.margin is not None) == [(0, pytest.approx(0.3))]
    with pytest.raises(Exception, match="more than one control"):
        metrics.margins(s.unionByName(s.where("is_control")), ["mode", "fold"], "r2").collect()
    dims = {"mode": s.select("mode").distinct(), "model": s.select("model").distinct(), "fold": s.select("fold").distinct()}
    assert [tuple(r) for r in metrics.missing_cells(s, dims).select("mode", "model", "fold").collect()] == [("a", "c", 1)]


def test_audit_prefers_the_canonical_name(spark):
    rows = [("zz", 1, "e", 3, True, True, True), ("1__e", 1, "e", 3, True, True, True), ("x", 2, "e", None, True, True, True), ("y", 3, "e", 3, True, False, True)]
    got = {r.name: r.status for r in vectors.audit(spark.createDataFrame(rows, "name string, cube int, encoder string, schema_version int, has_fields boolean, known boolean, readable boolean"), 3).collect()}
    assert got == {"zz": "duplicate", "1__e": "current", "x": "unstamped", "y": "foreign"}


def test_greedy_selection_equals_the_scan(spark):
    rng = np.random.default_rng(1)
    boxes = [(i, int(g), int(a), int(a) + 128, int(b), int(b) + 128) for i, (g, a, b) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 1500, 60), rng.integers(0, 1500, 60)))]
    df = spark.createDataFrame(boxes, "id long, grp int, r0 long, r1 long, c0 long, c1 long")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    order = [r.id for r in spatial.interleaved(df).orderBy("place").collect()]
    hit = lambda p, q: all(p[i] - 64 < q[i + 1] and q[i] - 64 < p[i + 1] for i in (2, 4))
    kept = []
    for i in order:
        if not any(hit(boxes[i], boxes[j]) for j in kept):
            kept.append(i)
    assert [r.id for r in spatial.greedy_selection(df, 10).orderBy("place").collect()] == kept[:10]
    assert {(r.a, r.b) for r in spatial.overlaps(df).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if hit(boxes[i], boxes[j])}


def test_nested_alpha_never_sees_test_rows(spark):
    import numpy as np

    from terrafold.operators import fit

    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.normal(size=240) * 2
    cube = np.arange(240) % 12
    alphas = [0.1, 10.0, 1000.0]
    inner = [(o, c, (c // 2) % 3) for o in range(2) for c in range(12) if c % 2 != o]
    inner_df = spark.createDataFrame(inner, "outer int, cube int, inner int")

    def chosen(targets):
        rows = spark.createDataFrame([(int(c), v.tolist(), float(t)) for c, v, t in zip(cube, x, targets)], "cube int, w array<double>, y double")
        return {r["outer"]: (r["alpha"], round(r["inner_r2"], 9)) for r in fit.nested_alpha(rows, inner_df, "w", "y", alphas).collect()}

    def plain(outer):
        best = None
        for alpha in alphas:
            scores = []
            for i in range(3):
                test = np.isin(cube, [c for o, c, f in inner if o == outer and f == i])
                train = np.isin(cube, [c for o, c, f in inner if o == outer and f != i])
                m, s = x[train].mean(0), x[train].std(0)
                z, my = (x[train] - m) / s, y[train].mean()
                coef = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[train] - my))
                e = y[test] - my - ((x[test] - m) / s) @ coef
                scores.append(1 - e @ e / ((y[test] - y[test].mean()) ** 2).sum())
            best = max(best or (-9e9, 0), (np.mean(scores), alpha))
        return best[1], round(best[0], 9)

    got = chosen(y)
    assert got == {o: plain(o) for o in range(2)}
    poisoned = np.where(cube % 2 == 0, 1e6, y)  # the test rows of outer fold 0
    assert chosen(poisoned)[0] == got[0]
