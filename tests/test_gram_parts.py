"""Sums of products of many keys: passed on in parts, so a task does not hold one matrix for each key that it meets."""

import numpy as np
import pandas as pd
import pytest

from terrafold.operators.fit import gram_parts


def test_many_keys_are_passed_on_in_parts():
    rng = np.random.default_rng(2)
    frames = [pd.DataFrame({"k": rng.integers(0, 200, 50), "v": list(rng.normal(size=(50, 4)))}) for _ in range(20)]
    matrix = lambda g: np.stack(g["v"].to_list())
    parts = list(gram_parts(iter(frames), ["k"], matrix, 16 * 60))
    assert len(parts) > 5 and max(map(len, parts)) <= 60 + 50
    got = {}
    for p in parts:
        for k, g in zip(p["k"], p["gram"]):
            got[k] = got.get(k, 0) + g
    every = pd.concat(frames)
    want = {k: (matrix(g).T @ matrix(g)).ravel() for k, g in every.groupby("k")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert [len(p) for p in gram_parts(iter([]), ["k"], matrix, 1)] == [0]
