"""The tuned logistic read-out against a plain solver, its choice, its blindness to test rows, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import folds, softmax

GRID = [0.01, 0.1, 1.0]
SCHEMA = "cube long, acq_idx long, vec array<double>, label string"


def plain(x, c, k, strength, balanced):
    """Descent of the same loss by steps of 1 / L with momentum, until nothing moves."""
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)])
    n_c = np.bincount(c, minlength=k)
    w = (len(c) / ((n_c > 0).sum() * np.maximum(n_c, 1)))[c] if balanced else np.ones(len(c))
    y = np.eye(k)[c]
    big = strength * np.linalg.eigvalsh(z.T @ (w[:, None] * z))[-1] / 2 + 1
    at = old = np.zeros((k, z.shape[1]))
    for i in range(20000):
        go = at + i / (i + 3) * (at - old)
        s = z @ go.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = strength * ((p - y) * w[:, None]).T @ z
        g[:, 1:] += go[:, 1:]
        old, at = at, go - g / big
        if np.abs(at - old).max() < 1e-13 and i > 500:
            break
    return at


def example(spark, n=120, seed=5):
    rng = np.random.default_rng(seed)
    lab, cube = rng.integers(0, 3, n), np.arange(n) % 12
    v = rng.normal(size=(n, 3))
    v[:, 0] += lab
    data = [(int(b), i, x.tolist(), str(c)) for i, (b, x, c) in enumerate(zip(cube, v, lab))]
    rows = spark.createDataFrame(data, SCHEMA)
    sides = rows.select("cube", "acq_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    sides = sides.withColumn("side", F.when(F.col("cube") % 3 == F.col("fold"), "test").otherwise("train"))
    return data, rows, sides, folds.inner_folds(sides)


def test_models_against_a_plain_solver(spark):
    data, rows, sides, inner = example(spark)
    deal = {(r.outer, r.cube): r.inner for r in inner.collect()}
    x = softmax.dealt(rows, sides, inner, "vec", "label", ["0", "1", "2"], 3)
    fits = softmax.paths(x, 3, GRID)
    assert len(fits) == 3 * 4 * 2
    cube, v, lab = (np.array([r[j] for r in data]) for j in (0, 2, 3))
    lab = lab.astype(int)
    for p, models in fits:
        m = np.array([b % 3 != p.outer and deal[p.outer, b] != p.inner for b in cube])
        assert p.n_train == m.sum()
        for c in GRID:
            assert np.abs(models[c] - plain(v[m], lab[m], 3, c, p.balanced)).max() < 1e-5


def test_choice_scores_and_poisoned_test_rows(spark):
    data, rows, sides, inner = example(spark)
    inner = spark.createDataFrame(inner.collect(), inner.schema)
    got = {(r.balanced, r.outer): r for r in softmax.tuned(rows, sides, inner, "vec", "label", GRID).collect()}
    assert len(got) == 6
    cube, v, lab = (np.array([r[j] for r in data]) for j in (0, 2, 3))
    lab = lab.astype(int)
    deal = {(r.outer, r.cube): r.inner for r in inner.collect()}

    def accuracy(train, test, c, balanced):
        w = plain(v[train], lab[train], 3, c, balanced)
        z = np.hstack([np.ones((test.sum(), 1)), (v[test] - v[train].mean(0)) / v[train].std(0)])
        said, true = (z @ w.T).argmax(1), lab[test]
        return np.mean([(said[true == k] == k).mean() for k in np.unique(true)])

    for (balanced, o), r in got.items():
        out, part = cube % 3 != o, np.array([deal.get((o, b), -1) for b in cube])
        inner_scores = {c: np.mean([accuracy(out & (part != i), part == i, c, balanced) for i in range(3)]) for c in GRID}
        best = min(GRID, key=lambda c: (-round(inner_scores[c], 12), c))
        assert r.c == best and r.inner_score == pytest.approx(inner_scores[best])
        assert r.balanced_accuracy == pytest.approx(accuracy(out, ~out, best, balanced)) and r.n_test == (~out).sum()
    # what lies in fold 0's test side changes neither its choice nor its fit
    poison = rows.withColumn("vec", F.when(F.col("cube") % 3 == 0, F.transform("vec", lambda e: e * 50 + 7)).otherwise(F.col("vec")))
    x = softmax.dealt(poison, sides, inner, "vec", "label", ["0", "1", "2"], 3)
    a = {(p.inner, p.balanced): m for p, m in softmax.paths(x, 3, GRID) if p.outer == 0}
    y = softmax.dealt(rows, sides, inner, "vec", "label", ["0", "1", "2"], 3)
    b = {(p.inner, p.balanced): m for p, m in softmax.paths(y, 3, GRID) if p.outer == 0}
    assert all(np.abs(a[k][c] - b[k][c]).max() < 1e-9 for k in b for c in GRID)
    after = {(r.balanced, r.outer): r for r in softmax.tuned(poison, sides, inner, "vec", "label", GRID).collect()}
    assert all(after[w, 0].c == got[w, 0].c and after[w, 0].inner_score == got[w, 0].inner_score for w in (False, True))


def test_a_tie_goes_to_the_stronger_penalty(spark):
    scores = spark.createDataFrame([(False, 0, i, c, 0.5) for i in (0, 1) for c in (0.1, 1.0, 10.0)] + [(False, 0, softmax.WHOLE, 10.0, 1.0)], "balanced boolean, outer int, inner int, c double, balanced_accuracy double")
    assert [(r.c, r.inner_score) for r in softmax.chosen(scores).collect()] == [(0.1, 0.5)]


def test_edges(spark):
    data, rows, sides, inner = example(spark)
    none = rows.limit(0)
    assert softmax.tuned(none, sides.limit(0), inner.limit(0), "vec", "label", GRID).count() == 0
    # one class alone: nothing to fit; null and broken vectors, null labels and a class in one cube take part as far as they can
    assert softmax.tuned(rows.withColumn("label", F.lit("a")), sides, inner, "vec", "label", [1.0]).count() == 0
    odd = spark.createDataFrame([(1, 900, None, "0"), (1, 901, [1.0, None, 2.0], "0"), (1, 902, [1.0, float("nan"), 0.0], "1"), (1, 903, [0.0, 0.0, 0.0], None), (2, 904, [9.0, 9.0, 9.0], "z")], SCHEMA)
    both = rows.unionByName(odd)
    where = both.select("cube", "acq_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold")).withColumn("side", F.when(F.col("cube") % 3 == F.col("fold"), "test").otherwise("train"))
    got = softmax.tuned(both, where, inner, "vec", "label", [1.0], (False,)).collect()
    assert sorted((r.outer, r.n_train, r.n_test) for r in got) == [(0, 81, 40), (1, 81, 40), (2, 80, 41)]
    # separable classes and a constant component at the weakest penalty: no step diverges
    flat = rows.withColumn("vec", F.array(F.col("label").cast("double") * 10, F.lit(3.0), F.get("vec", F.lit(1))))
    best = softmax.tuned(flat, sides, inner, "vec", "label", [1e-4, 1e2], (True,)).collect()
    assert len(best) == 3 and all(r.balanced_accuracy == 1.0 for r in best)
