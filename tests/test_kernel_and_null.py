"""Dual ridge against the primal one, the permutation null, feature sets, per-fold solves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import fit, kernel, mask, metrics, ranks

ALPHAS = [0.1, 10.0, 1000.0]


def wide(spark, n, d, folds=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(2, 3, (n, d))
    x[:, 1] = 4.0  # no spread
    y = x[:, 0] - x[:, 2] + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, i % folds, x[i].tolist(), float(y[i])) for i in range(n)], "id int, fold int, v array<double>, y double")


@pytest.mark.parametrize("n, d, block, chunk", [(60, 10, 16, 4), (45, 80, 7, 33), (30, 5, 64, 64)])
def test_dual_equals_primal(spark, n, d, block, chunk):
    x = wide(spark, n, d)
    a = {(r["fold"], r["alpha"]): (r["n_train"], r["r2"]) for r in kernel.ridge_dual(x, "v", "y", "fold", ["id"], ALPHAS, block, chunk).collect()}
    b = {(r["fold"], r["alpha"]): (r["n_train"], r["r2"]) for r in fit.ridge_path(x, "v", "y", "fold", ALPHAS).collect()}
    assert a.keys() == b.keys() and len(a) == 9
    for k, (n_train, r2) in a.items():
        assert n_train == b[k][0] and abs(r2 - b[k][1]) < 1e-8


def test_dual_of_three_numbers_and_two_rows(spark):
    """By hand: rows (1, 2, 0) and (3, 2, 4) with 1 and 5 are (-1, 0, -1) and (1, 0, 1) standardised, so their kernel is 2 and -2."""
    x = spark.createDataFrame([(0, 1, [1.0, 2.0, 0.0], 1.0), (1, 1, [3.0, 2.0, 4.0], 5.0), *((i, 0, [2.0 + i, 2.0, 2.0], 3.0 + i) for i in range(2, 10))], "id int, fold int, v array<double>, y double")
    got = {r["alpha"]: r for r in kernel.ridge_dual(x, "v", "y", "fold", ["id"], [1.0]).where("fold = 0").collect()}
    # dual weights -+2 / (4 + 1); a row 2 + i, 2, 2 is (i, 0, 0), so it gets 3 + i * 2 * 2 / 5
    sse, ys = sum((i - 0.8 * i) ** 2 for i in range(2, 10)), np.arange(2, 10) + 3.0
    assert abs(got[1.0]["r2"] - (1 - sse / ((ys - ys.mean()) ** 2).sum())) < 1e-9 and got[1.0]["n_train"] == 2


def test_dual_is_chosen_and_bounded(spark):
    with pytest.raises(kernel.TooManyRowsError):
        kernel.ridge_dual(wide(spark, 30, 4), "v", "y", "fold", ["id"], ALPHAS, most=29)
    x = wide(spark, 30, 40)
    a = {(r["fold"], r["alpha"]): r["r2"] for r in kernel.ridge(x, "v", "y", "fold", ["id"], ALPHAS).collect()}
    b = {(r["fold"], r["alpha"]): r["r2"] for r in kernel.ridge(x, "v", "y", "fold", ["id"], ALPHAS, most=3).collect()}
    assert all(abs(a[k] - b[k]) < 1e-8 for k in b)
    assert kernel.ridge_dual(x.limit(0), "v", "y", "fold", ["id"], ALPHAS).count() == 0


def test_permutation_inside_sides(spark):
    rnd = random.Random(3)
    rows = [(f, s, c, i) for f in range(2) for s, cubes in (("train", range(6)), ("test", [9])) for c in cubes for i in range(rnd.randint(3, 9))]
    p = fit.permutation(spark.createDataFrame(rows, "fold int, side string, cube int, acq_idx int"), "7")
    got = [tuple(r) for r in p.select("fold", "side", "cube", "acq_idx", "from_cube", "from_acq").collect()]
    assert sorted(r[:4] for r in got) == sorted(rows) == sorted((f, s, c, i) for f, s, _, _, c, i in got)
    assert any(r[2:4] != r[4:] for r in got)
    share = {(r["fold"], r["side"]): r["share"] for r in fit.same_cube_share(p).collect()}
    assert share[0, "test"] == share[1, "test"] == 1 and share[0, "train"] < 0.6
    again = [tuple(r) for r in fit.permutation(spark.createDataFrame(rows[::-1], "fold int, side string, cube int, acq_idx int"), "7").select("fold", "side", "cube", "acq_idx", "from_cube", "from_acq").collect()]
    assert sorted(again) == sorted(got)


def test_cells_of_a_frame_keep_one_sky(spark):
    frames = spark.range(40).select(F.lit(0).alias("fold"), F.lit("train").alias("side"), (F.col("id") % 5).alias("cube"), F.floor(F.col("id") / 5).alias("acq_idx"))
    cells = frames.select("cube", "acq_idx", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    sky = frames.select("cube", "acq_idx", F.rand(3).alias("w"))
    x = fit.with_sky(cells, fit.permutation(frames, "1"), sky).groupBy("cube", "acq_idx").agg(F.countDistinct("w").alias("skies"), F.count("*").alias("n"))
    assert x.where("skies <> 1 or n <> 16").count() == 0 and x.count() == 40


def test_feature_sets():
    columns = ["a_mean", "a_std", "b_mean"]
    assert mask.column_sets(columns, {"x": ("a_",), "y": ("b_",)}) == {"x": [0, 1], "y": [2]}
    for groups in ({"x": ("a_",)}, {"x": ("a_",), "y": ("a_std", "b_")}, {"x": ("a_", "b_"), "y": ("c_",)}):
        with pytest.raises(ValueError):
            mask.column_sets(columns, groups)


def test_baseline_has_its_own_verdict(spark):
    s = spark.createDataFrame([(0, m, f, v) for m, v in (("base", 0.1), ("good", 0.3), ("bad", 0.0)) for f in range(3)], "mode int, model string, fold int, r2 double")
    got = {r["model"]: (r["verdict"], r["mean"] is None) for r in metrics.paired_verdict(s, ["mode"], "r2", "base").collect()}
    assert got == {"base": ("baseline", True), "good": ("passed", False), "bad": ("lossy", False)}


@pytest.mark.parametrize("rows", [3, 50, 65_536])
def test_percentiles_and_ranks_in_ranges(spark, rows):
    """A hot key and a hot value, over ranges of a few rows each."""
    rnd = random.Random(5)
    data = [("hot", float(rnd.choice([1, 1, 1, 2, 3.5, rnd.random()]))) for _ in range(400)] + [("one", 7.0)] + [(None, float(i % 3)) for i in range(10)] + [("none", None)]
    x = spark.createDataFrame(data, "k string, v double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["k"]: [r[s] for s in shares] for r in ranks.percentiles_by(x, ["k"], "v", shares, rows).collect()}
    for k in ("hot", "one", None):
        values = [v for q, v in data if q == k]
        assert np.allclose(got[k], np.quantile(values, list(shares.values())))
    assert "none" not in got
    assert abs(ranks.percentiles_by(x, [], "v", {"m": 0.5}, rows).first()["m"] - np.median([v for _, v in data if v is not None])) < 1e-12
    placed = {(r["k"], r["v"]): r["r"] for r in ranks.average_ranks(x, ["k"], "v", "r", rows).collect()}
    hot = sorted(v for q, v in data if q == "hot")
    for v in set(hot):
        places = [i + 1 for i, w in enumerate(hot) if w == v]
        assert placed["hot", v] == sum(places) / len(places)


@pytest.mark.parametrize("rows", [4, 65_536])
def test_scores_in_ranges(spark, rows):
    rnd = random.Random(6)
    data = [(k, i, float(rnd.randint(0, 6)), float(rnd.randint(0, 6))) for k in (1, 2) for i in range(90)]
    x = spark.createDataFrame(data, "k int, id long, y double, pred double")
    for r in metrics.error_concentration(x, ["k"], "y", "pred", rows=rows).collect():
        e = sorted(((y - p) ** 2 for k, _, y, p in data if k == r["k"]), reverse=True)
        assert abs(r["share_5"] - sum(e[:4]) / sum(e)) < 1e-12 and abs(r["share_1"] - e[0] / sum(e)) < 1e-12
        assert abs(r["med_ae"] - np.median(np.sqrt(e))) < 1e-12 and r["n"] == 90
    for r in metrics.spearman(x, ["k"], "y", "pred", rows=rows).collect():
        rank = lambda v: np.array([(np.sum(v < u) + np.sum(v <= u) + 1) / 2 for u in v])
        a, b = (rank(np.array([d[i] for d in data if d[0] == r["k"]])) for i in (2, 3))
        assert abs(r["rho"] - np.corrcoef(a, b)[0, 1]) < 1e-12 and r["n"] == 90
    members = x.select("k", F.col("pred").alias("x"))
    for r in metrics.ensemble_crps(x.select("k", "id", "y"), members, ["k"], rows).collect():
        m = np.array([d[3] for d in data if d[0] == r["k"]])
        assert abs(r["crps"] - (np.abs(m - r["y"]).mean() - np.abs(m[:, None] - m[None, :]).mean() / 2)) < 1e-12
