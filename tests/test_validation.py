"""A proxy held against the real thing: means, margins, power and overlap by hand."""

import numpy as np
import pytest

from terrafold.operators import reports


def test_validation(spark):
    data = {("proxy", "weather"): [0.1, 0.2, 0.3], ("proxy", "observation"): [0.0, 0.1, 0.1], ("real", "weather"): [0.8, 0.81, 0.82], ("real", "observation"): [0.05, 0.1, 0.2], ("proxy", "alone"): [0.5, 0.5, None]}
    rows = [(s, m, i, v) for (s, m), vs in data.items() for i, v in enumerate(vs)]
    got = {(r.stage, r.model): r for r in reports.validation(spark.createDataFrame(rows, "stage string, model string, fold int, v double"), "v", "observation", "proxy", "real").collect()}
    assert len(got) == 5
    w = got["proxy", "weather"]
    sd = np.std([0.1, 0.2, 0.3], ddof=1)
    assert w.mean == pytest.approx(0.2) and w.margin == pytest.approx(0.2 - 0.2 / 3) and w.proxy_minus_real == pytest.approx(0.2 - 0.81) and not w.overlap
    assert w.mde == pytest.approx(2.801585 * sd / np.sqrt(3)) and w.folds_needed == int(np.ceil((2.801585 * sd / 0.2) ** 2))
    assert got["real", "observation"].margin is None and got["real", "observation"].overlap and got["proxy", "observation"].overlap
    # a model that the other stage lacks; a null fold is no fold
    a = got["proxy", "alone"]
    assert a.k == 2 and a.proxy_minus_real is None and a.overlap is None and a.mde == 0 and a.folds_needed == 0


def test_validation_of_nothing(spark):
    assert reports.validation(spark.createDataFrame([], "stage string, model string, fold int, v double"), "v", "observation", "proxy", "real").count() == 0
