"""The forecast table against plain fits of each fold, poisoned test rows, edge cases, margins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import axes, fit, forecast

KEYS = ["mode"]
SETS = {"both": [0, 1], "observation": [1], "band_matched": [0]}
SCHEMA = "mode string, delta int, fold long, cube long, acq_idx long, vec array<double>, doy int, y double, held double, sky array<double>"


def example():
    rng = np.random.default_rng(5)
    data = []
    for i in range(240):
        v = rng.normal(size=2) * [3, 0.5]
        doy, held = int(rng.integers(1, 366)), float(rng.normal())
        y = float(0.4 * v[0] - v[1] + 0.3 * held + np.cos(doy / 58) + rng.normal() * 0.3)
        data.append(("m", (5, 25, 50)[i % 3], i % 20 % 4, i % 20, i, v.tolist(), doy, y, held, rng.normal(size=2).tolist()))
    return data


def run(rows):
    got = forecast.forecasts(rows, KEYS, "vec", 2, fit.harmonic_design("doy", 2), "doy", "y", "held", SETS)
    return {(r.delta, r.fold, r.model): r for r in got.collect()}


def ridge(x, y):
    sd = x.std(0)
    z = (x - x.mean(0)) / sd
    c = np.linalg.solve(z.T @ z + x.shape[1] * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return c, y.mean() - x.mean(0) @ c


def harmonics(doy):
    w = 2 * np.pi * doy / 365.25
    return np.column_stack([np.ones(len(doy)), np.cos(w), np.sin(w), np.cos(2 * w), np.sin(2 * w)])


def test_against_plain_fits(spark):
    data = example()
    got = run(spark.createDataFrame(data, SCHEMA))
    delta, fold, doy, y, held = (np.array([r[i] for r in data]) for i in (1, 2, 6, 7, 8))
    v = np.array([r[5] for r in data])
    assert len(got) == 3 * 4 * (len(SETS) + 3)
    for (h, f, model), r in got.items():
        a, b = (delta == h) & (fold != f), (delta == h) & (fold == f)
        n = a.sum()
        if model in SETS:
            c, i = ridge(v[a][:, SETS[model]], y[a])
            p = v[b][:, SETS[model]] @ c + i
        elif model == "persistence":
            p = held[b]
        elif model == "climatology_proxy":
            p = harmonics(doy[b]) @ np.linalg.lstsq(harmonics(doy[a]), y[a], rcond=None)[0]
        else:
            every = fold != f
            p, n = np.polyval(np.polyfit(delta[every], y[every], 2), h), every.sum()
        e, t = y[b] - p, y[b]
        assert (r.n_train, r.n_test) == (n, b.sum())
        assert r.sse == pytest.approx((e**2).sum()) and r.rmse == pytest.approx(np.sqrt((e**2).mean()))
        assert r.sse_held == pytest.approx(((t - held[b]) ** 2).sum())
        assert r.r2 == pytest.approx(1 - (e**2).sum() / ((t - t.mean()) ** 2).sum())
        if r.coef:
            z = np.column_stack([np.ones(b.sum()), v[b], harmonics(doy[b])[:, 1:]])
            assert np.allclose(z @ np.array(r.coef), p)


def test_test_rows_do_not_reach_a_fit(spark):
    rows = spark.createDataFrame(example(), SCHEMA)
    before, after = run(rows), run(rows.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * 50 + 7).otherwise(F.col("y"))))
    for k, r in before.items():
        if k[1] == 1 and r.coef:
            assert np.allclose(after[k].coef, r.coef, atol=1e-9) and after[k].sse != pytest.approx(r.sse)


def test_edges(spark):
    data = example()
    rows = spark.createDataFrame(data, SCHEMA)
    assert run(rows.limit(0)) == {}
    odd = [("m", 5, 1, 1, 900, None, 3, 1.0, 1.0, None), ("m", 5, 1, 1, 901, [1.0, None], 3, 1.0, 1.0, None), ("m", 5, 1, 1, 902, [1.0, float("nan")], 3, 1.0, 1.0, None), ("m", 5, 1, 1, 903, [1.0, 1.0], 3, None, 1.0, None),
           ("m", 5, 1, 1, 904, [1.0, 1.0], 3, 1.0, float("inf"), None), ("m", 5, 1, 1, 905, [1.0, 1.0], None, 1.0, 1.0, None)]
    a, b = run(rows), run(rows.unionByName(spark.createDataFrame(odd, SCHEMA)))
    assert a.keys() == b.keys() and all(a[k].n_train == b[k].n_train and a[k].sse == pytest.approx(b[k].sse) for k in a)
    # two horizons do not tell a polynomial, one fold has no training side, few days no curve
    assert "horizon_only" not in {k[2] for k in run(rows.where("delta < 50"))}
    assert run(rows.where("fold = 2")) == {}
    assert "climatology_proxy" not in {k[2] for k in run(rows.withColumn("doy", F.col("doy") % 4 + 1))}
    # a fold that one horizon lacks has no row there, and counts at the others
    part = run(rows.where("not (fold = 3 and delta = 50)"))
    assert (50, 3, "both") not in part and (25, 3, "both") in part
    # a constant feature is harmless
    flat = run(rows.withColumn("vec", F.array(F.get("vec", F.lit(0)), F.lit(2.0))))
    assert flat[5, 0, "both"].coef[2] == 0


def test_permutation_stays_inside_sides_and_frames(spark):
    data = example()
    # two cells a frame: both get the same sky
    rows = spark.createDataFrame(data, SCHEMA)
    both = rows.unionByName(rows.withColumn("y", F.col("y") + 1))
    got = forecast.permuted_forecasts(both, KEYS, "sky", "y", "held", "7").collect()
    assert len(got) == 12 and all(r.n_train + r.n_test == 160 and r.model == "permutation" for r in got)
    again = forecast.permuted_forecasts(both, KEYS, "sky", "y", "held", "7").collect()
    assert sorted((r.delta, r.fold, round(r.sse, 9)) for r in got) == sorted((r.delta, r.fold, round(r.sse, 9)) for r in again)
    # the skies of the test side never reach the fit: with one sky on each side, both are constant and the mean is left
    poison = rows.withColumn("sky", F.when(F.col("fold") == 1, F.array(F.lit(1e6), F.lit(1e6))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    y, fold, delta = (np.array([r[i] for r in data]) for i in (7, 2, 1))
    for r in forecast.permuted_forecasts(poison, KEYS, "sky", "y", "held", "7").where("fold = 1").collect():
        train, test = y[(delta == r.delta) & (fold != 1)], y[(delta == r.delta) & (fold == 1)]
        assert r.sse == pytest.approx(((test - train.mean()) ** 2).sum())
    assert forecast.permuted_forecasts(rows.limit(0), KEYS, "sky", "y", "held", "7").count() == 0


def test_table(spark):
    rows = spark.createDataFrame(example(), SCHEMA)
    scores = forecast.forecasts(rows, KEYS, "vec", 2, fit.harmonic_design("doy", 2), "doy", "y", "held", SETS)
    got = {(r.delta, r.model): r for r in forecast.forecast_table(scores, ["mode", "delta"]).collect()}
    per = run(rows)
    assert len(got) == 18
    for (h, m), r in got.items():
        s = [x for k, x in per.items() if k[0] == h and k[2] == m]
        tot = {c: sum(x[c] for x in s) for c in ("n_test", "sy", "syy", "sse", "sse_held")}
        assert r.r2_pooled == pytest.approx(1 - tot["sse"] / (tot["syy"] - tot["sy"] ** 2 / tot["n_test"]))
        assert r.skill == pytest.approx(1 - tot["sse"] / tot["sse_held"]) and r.k == 4 and r.n == 80
        assert r.ci_lo < r.r2_pooled < r.ci_hi and r.is_control == (m != "both")
        assert r.margin_permutation is None
        for c in ("observation", "persistence", "climatology_proxy", "horizon_only"):
            own = r[f"margin_{c}"]
            assert own is None if c == m else own == pytest.approx(r.r2_pooled - got[h, c].r2_pooled)
    assert got[5, "persistence"].skill == pytest.approx(0)
    # one fold alone has a score and no interval
    one = forecast.forecast_table(scores.where("fold = 0"), ["mode", "delta"]).collect()
    assert len(one) == 18 and all(r.ci_lo is None and r.r2_pooled is not None for r in one)


def test_window_means(spark):
    days = spark.createDataFrame([(i, float(i), float(i * i)) for i in (0, 1, 2, 4, 5)], "day int, a double, b double")
    rows = spark.createDataFrame([(1, 0, 1, 0, 4), (1, 1, 2, 1, 5), (1, 2, 3, 3, 5), (1, 3, 4, 2, 2)], "cube int, acq_idx int, acq_target int, day_a int, day_b int")
    got = {r.acq_idx: (r.a, r.b) for r in forecast.window_means(rows, days, "day", ["a", "b"]).collect()}
    assert got == {0: (pytest.approx(7 / 3), pytest.approx(7)), 1: (pytest.approx(11 / 3), pytest.approx(15))}


def test_common_cells(spark):
    px = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 1, 0, 2.0), (1, 0, 2, 1, 5.0), (1, 1, 0, 0, 4.0), (1, 1, 1, 0, None), (1, 1, 2, 1, None)], "cube int, acq_idx int, px int, cell int, ndvi double")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 1, 2)], "cube int, acq_idx_a int, acq_idx_b int")
    assert [tuple(r) for r in axes.common_cells(pairs, px, ["px"], "cell").collect()] == [(1, 0, 1, 0, 1, 1.0, 4.0, 3.0)]
    assert axes.common_cells(pairs, px.limit(0), ["px"], "cell").count() == 0


def test_every_fold_has_the_permutation(spark):
    from terrafold.plans import catalogue, probes

    x = probes.forecast_scores(spark, "/root/testdata/sf0.001")
    got = {m: {tuple(r) for r in x.where(F.col("model") == m).select("mode", "aggregation", "delta", "fold").collect()} for m in ("weather_only", "permutation")}
    assert got["weather_only"] == got["permutation"] and len({g for g in got["permutation"] if g[0] == "loco"}) > 100
    assert "loco'" not in catalogue.ORACLE_SQL["forecast_probe"].replace("'loco', 'mean'", "")
