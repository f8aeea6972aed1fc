"""The appearance job against plain one-vs-rest ridges of each side, poisoned test rows, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import appearance, folds, jobs

SETS, ALPHAS = {"all": [0, 1, 2], "pair": [2, 0]}, [0.1, 10.0, 1000.0]
SCHEMA = "target string, cube long, acq_idx long, vec array<double>, label string"


def example(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(180):
        c = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        data.append(("t", i % 15, i, (rng.normal(size=3) * [1, 4, 0.3] + np.array([c, -2 * c, 0.2 * (c == 2)])).tolist(), "abc"[c]))
    rows = spark.createDataFrame(data, SCHEMA)
    table = rows.select("cube", "acq_idx", F.explode(F.array(*map(F.lit, range(3)))).alias("fold")).withColumn("side", F.when(F.col("cube") % 3 == F.col("fold"), "test").otherwise("train"))
    deal = jobs.deal_of(table, folds.inner_folds(table))
    return data, rows, spark.createDataFrame(deal.collect(), deal.schema)


def run(rows, deal):
    return {(r.outer, r.feature_set, r.weights): r for r in appearance.appearance(rows, deal, ["target"], "vec", 3, "label", SETS, ALPHAS).collect()}


def guesses(x, y, z, alpha, balanced):
    """Guesses for ``z`` of ridges fitted on rows, not on sums."""
    mean, sd = x.mean(0), x.std(0)
    classes = sorted(set(y))
    w = np.array([len(y) / (len(classes) * (y == c).sum()) if balanced else 1.0 for c in y])
    u, v = (x - mean) / sd, (z - mean) / sd
    centre = w @ u / w.sum()
    scores = []
    for c in classes:
        t = np.where(y == c, 1.0, -1.0)
        my = w @ t / w.sum()
        k = np.linalg.solve(((u - centre) * w[:, None]).T @ (u - centre) + alpha * np.eye(u.shape[1]), ((u - centre) * w[:, None]).T @ (t - my))
        scores.append((v - centre) @ k + my)
    return np.array(classes)[np.argmax(scores, axis=0)]


def measures(y, p):
    there = sorted(set(y))
    recall = [(p[y == c] == c).mean() for c in there]
    f1 = [2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in there]
    return np.mean(recall), np.mean(f1)


@pytest.mark.parametrize("limit", [appearance.BROADCAST, 0])
def test_against_plain_ridges(spark, monkeypatch, limit):
    monkeypatch.setattr(appearance, "BROADCAST", limit)
    data, rows, deal = example(spark)
    part = {(r.outer, r.cube): r.inner for r in deal.collect()}
    got = run(rows, deal)
    cube, v, y = np.array([r[1] for r in data]), np.array([r[3] for r in data]), np.array([r[4] for r in data])
    assert len(got) == 3 * 2 * 2
    for (o, name, weights), r in got.items():
        x, mine = v[:, SETS[name]], np.array([part[o, c] for c in cube])
        tried = {}
        for a in ALPHAS:
            folds_of = [measures(y[mine == i], guesses(x[(mine >= 0) & (mine != i)], y[(mine >= 0) & (mine != i)], x[mine == i], a, weights == "balanced"))[0] for i in range(3)]
            tried[a] = round(float(np.mean(folds_of)), 12)
        best = max(ALPHAS, key=lambda a: (tried[a], a))
        assert r.alpha == best and r.inner_score == pytest.approx(tried[best]) and r.at_edge == (best != 10.0)
        test, train = mine == -1, mine >= 0
        ba, f1 = measures(y[test], guesses(x[train], y[train], x[test], best, weights == "balanced"))
        assert r.balanced_accuracy == pytest.approx(ba) and r.macro_f1 == pytest.approx(f1)
        assert (r.n_train, r.n_test) == (train.sum(), test.sum()) and r.dummy == pytest.approx(1 / len(set(y[test])))


def test_test_rows_do_not_choose(spark):
    _, rows, deal = example(spark)
    before, after = run(rows, deal), run(rows.withColumn("label", F.when(F.col("cube") % 3 == 1, "c").otherwise(F.col("label"))), deal)
    assert all(after[k].alpha == r.alpha and after[k].inner_score == pytest.approx(r.inner_score) for k, r in before.items() if k[0] == 1)


def test_edges(spark):
    _, rows, deal = example(spark)
    assert run(rows.limit(0), deal) == {} and run(rows, deal.limit(0)) == {} and run(rows.withColumn("label", F.lit("a")), deal) == {}
    odd = spark.createDataFrame([("t", 1, 900, None, "a"), ("t", 1, 901, [1.0, None, 1.0], "a"), ("t", 1, 902, [1.0, float("nan"), 1.0], "a"), ("t", 1, 903, [1.0, 1.0, 1.0], None), ("t", None, 904, [1.0, 1.0, 1.0], "a")], SCHEMA)
    a, b = run(rows, deal), run(rows.unionByName(odd), deal)
    assert a.keys() == b.keys() and all((a[k].n_train, a[k].alpha) == (b[k].n_train, b[k].alpha) and a[k].balanced_accuracy == pytest.approx(b[k].balanced_accuracy) for k in a)
