"""Boosted trees from the sums of cells against MLlib's, poisoned test rows, odd input, the number of rounds."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terrafold.operators import readouts
from terrafold.plans import catalogue


def example(spark, values=12):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, values, 600), rng.integers(0, 9, 600)
    y = np.sin(a) + 0.3 * b * (a > 5) + rng.normal(size=600) * 0.2
    return spark.createDataFrame([(i, float(u), int(v), float(w), i % 3) for i, (u, v, w) in enumerate(zip(a, b, y))], "id int, a double, b int, y double, fold int")


def test_against_mllib(spark):
    df = example(spark)
    got = {r.id: r.pred for r in readouts.boosted_by_fold(df, ["a", "b"], "y", [0, 1, 2], "fold", rounds=8).collect()}
    x = df.withColumn("_x", array_to_vector(F.array(F.col("a"), F.col("b").cast("double"))))
    model = GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="pred", maxIter=8, stepSize=0.1, minInstancesPerNode=20, seed=0)
    want = {r.id: r.pred for r in model.fit(x.where("fold != 1")).transform(x.where("fold = 1")).collect()}
    assert len(got) == 600 and all(got[i] == pytest.approx(p, abs=1e-9) for i, p in want.items())


def test_test_rows_do_not_reach_a_fit_and_many_values_are_binned(spark):
    df = example(spark, values=400)
    run = lambda x: {r.id: r.pred for r in readouts.boosted_by_fold(x, ["a", "b"], "y", [0, 1], "fold", rounds=5).collect()}
    a, b = run(df), run(df.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * 50 + 7).otherwise(F.col("y"))))
    assert set(a) == {i for i in range(600) if i % 3 < 2}  # fold 2 trains only
    assert all(a[i] == b[i] for i in a if i % 3 == 1) and any(a[i] != b[i] for i in a if i % 3 == 0)
    with pytest.raises(Exception, match="null b"):
        run(df.withColumn("b", F.when(F.col("id") != 7, F.col("b"))))


def test_the_query_runs_all_rounds(spark, monkeypatch):
    seen = []
    real = readouts.boosted_by_fold
    monkeypatch.setattr(readouts, "boosted_by_fold", lambda *a, rounds=200, **k: seen.append(rounds) or real(*a, rounds=rounds, **k))
    got = catalogue.QUERIES["boosted_trees"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [200] and len(got) == 3 and all(r.r2 is not None for r in got)
