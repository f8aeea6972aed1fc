"""Chance levels and collinearity of features with the date, by numpy and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import reports


def test_feature_collinearity(spark):
    rng = np.random.default_rng(1)
    doy = rng.integers(1, 20, 200) * 5
    v = np.column_stack([doy + rng.normal(size=200), rng.normal(size=200), doy * 2.0, 1e6 + rng.normal(size=200)])
    schema = "doy int, v array<double>"
    df = spark.createDataFrame([(int(d), x.tolist()) for d, x in zip(doy, v)] + [(None, [1.0] * 4), (3, None), (4, [1.0, None, 1.0, 1.0])], schema)
    got = reports.feature_collinearity(df, "doy", "v").first()
    inside = v - np.array([v[doy == d].mean(0) for d in doy])
    share = inside.std(0) / v.std(0)
    n = np.bincount(doy)
    assert (got.n_days, got.span, got.one_lattice, got.n_shared) == (len(set(doy)), doy.max() - doy.min(), True, n[n > 1].sum())
    assert (got.share_min, got.share_median, got.share_max) == pytest.approx((share.min(), np.median(share), share.max()), abs=1e-9)
    none = reports.feature_collinearity(df.limit(0), "doy", "v").first()
    assert none.n_days == 0 and none.n_shared == 0 and none.share_max is None
    flat = reports.feature_collinearity(df.withColumn("v", F.array(F.lit(2.0))), "doy", "v").first()
    assert flat.share_min is None and flat.one_lattice is False


def test_chance(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 5), ("a", 5), ("a", 9), ("a", None), ("b", 7), ("c", None)], "k string, m int")
    got = {r.k: r for r in reports.chance(df, ["k"], "m", 12).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a.n, a.n_classes, a.n_missing, a.majority_class) == (5, 3, 9, 3)
    assert (a.majority_share, a.balanced_accuracy, a.macro_f1) == pytest.approx((0.4, 1 / 3, 0.8 / 1.4 / 3))
    assert got["b"].macro_f1 == 1.0
