"""Hand values and brute force for classifiers, the Gaussian score and result tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import metrics, readouts
from terrafold.sources import results


def test_gaussian_crps_by_hand(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, -1.0, 0.0), (1, 0.0, 0.0)], "fold int, y double, pred double")
    got = readouts.gaussian_crps(df, "y", "pred", "fold").where("fold = 1").first()
    assert got.sigma == pytest.approx(2**0.5) and got.crps == pytest.approx(0.330494, abs=1e-5)
    assert readouts.gaussian_crps(df, "y", "pred", "fold").where("fold = 0 and crps is not null").count() == 0


def test_ridge_classifier_against_numpy(spark):
    rng = np.random.default_rng(3)
    v, lab, fold = rng.normal(size=(90, 4)), rng.integers(0, 3, 90), np.arange(90) % 3
    v[:, 0] += lab
    df = spark.createDataFrame([(int(f), str(c), x.tolist()) for f, c, x in zip(fold, lab, v)], "fold int, label string, vec array<double>")
    for balanced in (False, True):
        models = {r.fold: r.models for r in readouts.ridge_classifier(df, "vec", "label", "fold", 2.0, balanced).collect()}
        for f in range(3):
            x, c = v[fold != f], lab[fold != f]
            sd = x.std(0)
            w = (len(c) / (3 * np.bincount(c)))[c] if balanced else np.ones(len(c))
            for m in models[f]:
                y = np.where(c == int(m.label), 1.0, -1.0)
                xm, ym = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
                z = (x - xm) / sd
                coef = np.linalg.solve(z.T @ (w[:, None] * z) + 2.0 * np.eye(4), z.T @ (w * (y - ym))) / sd
                assert np.allclose(coef, m.coef) and m.intercept == pytest.approx(ym - xm @ coef)


def test_result_table_survives_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, \"y\"", 0.1, True), ("a", "z", None, False), ("b", "z", 2.0, False)], "k string, model string, r2 double, ctl boolean")
    where = str(tmp_path / "t")
    assert results.earlier(spark, where, df.schema) is None
    results.write_csv(df, where)
    back = results.read_csv(spark, where, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert [tuple(r) for r in results.invariant_violations(back, ["k"], "ctl").collect()] == [("b", "no control")]
    assert results.compare(back, None, ["k", "model"], "r2").where(F.col("change").isNotNull()).count() == 0


def test_t_quantiles_of_many_folds(spark):
    want = {1: None, 2: 12.706205, 5: 2.776445, 11: 2.228139, 12: 2.200985, 30: 2.045230, 1000: 1.962341}
    df = spark.createDataFrame([(k, float(i % 2)) for k in want for i in range(k)], "k int, v double")
    for r in metrics.t_interval(df.withColumnRenamed("k", "folds"), ["folds"], "v").collect():
        t = r.std and (r.ci_hi - r["mean"]) * r.k**0.5 / r.std
        assert t == (want[r.folds] and pytest.approx(want[r.folds], abs=1e-5))
    sums = spark.range(30).selectExpr("1 as m", "id as fold", "10L as n", "id * 1.0D as sy", "(50 + id * id)*1.0D as syy", "(5 + id % 7) * 1.0D as sse")
    row = metrics.jackknife(sums, ["m"]).first()
    x = sums.toPandas()
    left = [1 - (x.sse.sum() - x.sse[i]) / (x.syy.sum() - x.syy[i] - (x.sy.sum() - x.sy[i]) ** 2 / 290) for i in range(30)]
    assert (row.ci_hi - row.pooled) / (29 * np.var(left)) ** 0.5 == pytest.approx(2.045230, abs=1e-5)
