"""Arrow batches of the appearance table: a row stands in every place that it was dealt, and ties go to the greatest label."""

import numpy as np
import pyarrow as pa
import pytest

from terrafold.operators import appearance
from terrafold.operators.appearance import class_grams, guess_counts, kind_of, sides_of


def batch(rows):
    kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["target", "label", "v", "outer", "inner"])


ROWS = [("t", "b", [1.0, 2.0], [0, 1], [-1, 2]), ("t", "a", [3.0, -1.0], [0, 1], [-1, 2]), ("u", "b", [0.5, 0.5], [1], [0]), ("t", "b", [2.0, 2.0], [1], [2])]


def test_grams_of_every_place():
    got = {tuple(r[k] for k in ("target", "outer", "inner", "label")): r["gram"] for b in class_grams([batch(ROWS[:2]), batch(ROWS[2:]), batch([])], ["target"], 2, kind_of(["target"])) for r in b.to_pylist()}
    want = {}
    for target, label, v, outer, inner in ROWS:
        z = np.array([1.0, *v])
        for o, i in zip(outer, inner):
            want[target, o, i, label] = want.get((target, o, i, label), 0) + np.outer(z, z)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].ravel()) for k in want)


@pytest.mark.parametrize("scored", [1, 1024])
def test_guesses_are_counted_and_ties_go_to_the_greatest_label(monkeypatch, scored):
    monkeypatch.setattr(appearance, "SCORED", scored)
    model = lambda name, classes: {"target": "t", "outer": 1, "inner": 2, "feature_set": name, "weights": "none", "alpha": 1.0, "n_train": 5, "majority": "b", "classes": [dict(zip(("label", "coef", "intercept"), c)) for c in classes]}
    known = sides_of([model("even", [("a", [1.0, 0.0], 0.0), ("b", [1.0, 0.0], 0.0)]), model("split", [("a", [1.0, 0.0], 0.0), ("b", [0.0, 1.0], 0.5)])], ["target"])
    got = sorted((r["feature_set"], r["label"], r["guess"], r["_n"]) for b in guess_counts([batch(ROWS)], ["target"], 2, known, kind_of(["target"])) for r in b.to_pylist())
    assert got == [("even", "a", "b", 1), ("even", "b", "b", 2), ("split", "a", "a", 1), ("split", "b", "b", 2)]
