"""Encoder assembly and observation features by hand, with missing, doubled and null rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terrafold.operators import assembly

VEC = "cube long, acq_idx long, encoder string, vec array<double>"
FRAMES = "cube long, acq_idx long, day_idx long, clear_frac double"


def test_assembly(spark):
    manifest = spark.createDataFrame([(1, 0, "x"), (1, 2, "y")], "cube long, acq_idx long, note string")
    rows = [(1, 0, "a", [1.0]), (1, 0, "b", [2.0, 3.0]), (1, 2, "a", [4.0]), (1, 2, "b", [5.0, 6.0]), (9, 9, "a", [0.0]), (1, 2, "other", None)]
    good = spark.createDataFrame(rows, VEC)
    got = {r.acq_idx: r for r in assembly.assembled(manifest, good, ["a", "b"]).collect()}
    assert got[0].vec_a == [1.0] and got[0].vec_b == [2.0, 3.0] and got[2].vec_b == [5.0, 6.0] and got[2].note == "y" and len(got) == 2
    assert [tuple(r) for r in assembly.assembly_violations(manifest, good, ["a", "b"]).collect()] == [(9, 9, "a", "not_in_manifest")]
    bad = spark.createDataFrame([*rows[1:], (1, 2, "a", [7.0]), (1, 0, "a", None)], VEC)
    assert sorted(tuple(r) for r in assembly.assembly_violations(manifest, bad, ["a", "b"]).collect()) == [(1, 0, "a", "missing"), (1, 2, "a", "doubled"), (9, 9, "a", "not_in_manifest")]
    with pytest.raises(PySparkException, match="not one vector of a for frame"):
        assembly.assembled(manifest, bad, ["a", "b"]).collect()
    assert assembly.assembled(manifest.limit(0), bad, ["a", "b"]).count() == 0
    with pytest.raises(PySparkException, match="not one vector"):
        assembly.assembled(manifest, good.limit(0), ["a"]).collect()


def test_observation_features(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0.6), (1, 1, 10, 0.7), (1, 4, 25, 0.8), (1, 5, 60, 0.9), (2, 0, 3, 1.0)], FRAMES)
    rows = spark.createDataFrame([(1, 1, 5), (1, 4, 5), (1, 0, 4), (2, 0, 1), (1, 5, 9)], "cube long, acq_idx long, acq_target long")
    read = lambda x: {(r.cube, r.acq_idx): r.features for r in x.collect()}
    one = read(assembly.observation_features(rows, frames, 1, 3))
    assert one == {(1, 1): [0.7, 10.0, 0.9], (1, 4): [0.8, 25.0, 0.9], (1, 0): [0.6, 0.0, 0.8]}
    assert read(assembly.observation_features(rows, frames, 3, 2)) == {(1, 4): [0.6, 0.7, 0.8, 15.0, 0.9]}
    cells = spark.createDataFrame([(1, 1, 0, 0.1), (1, 1, 1, 0.2), (1, 5, 1, 0.3), (1, 4, 0, 0.4)], "cube long, acq_idx long, cell int, clear_frac double")
    got = {(r.acq_idx, r.cell): r.features for r in assembly.observation_cells(rows, frames, cells, 3).collect()}
    assert got == {(1, 1): [0.2, 10.0, 0.3]}
    assert assembly.observation_features(rows, frames.limit(0)).count() == 0 and assembly.observation_cells(rows, frames, cells.limit(0)).count() == 0
    assert assembly.observation_features(rows.withColumn("features", F.lit(1)), frames).schema["features"].dataType.simpleString() == "array<double>"
