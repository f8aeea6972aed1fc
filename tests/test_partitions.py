"""Tasks that group or join hold a bounded number of rows, and tables that are read again are derived once."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from terrafold.operators import axes, fit, folds, ranks
from terrafold.operators.ranks import dealt, written
from terrafold.plans import catalogue, probes  # noqa: F401  probes registers its queries
from terrafold.sources import minicube as mc

SF = "/root/testdata/sf0.001"


def most_rows(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 5000)
    few, many = dealt(df, ["k"], rows=5000), dealt(df, ["k"], rows=500)
    assert many.rdd.getNumPartitions() == 40 and most_rows(many) < 1000
    assert few.groupBy("k").count().count() == many.groupBy("k").count().count() == 5000
    assert dealt(df, ["k"], n=100_000, rows=500).rdd.getNumPartitions() == 200


def test_pixels_and_frames_are_dealt_by_their_input(spark, monkeypatch):
    lines, orders = (mc.table(spark, SF, t).count() for t in ("lineitem", "orders"))
    want = sorted(map(str, catalogue.QUERIES["frame_cell_clear_fraction"](spark, SF).collect()))
    monkeypatch.setattr(mc, "dealt", partial(dealt, rows=50))
    x = catalogue.QUERIES["frame_cell_clear_fraction"](spark, SF)
    assert x.rdd.getNumPartitions() == -(-lines // 50)
    assert sorted(map(str, x.collect())) == want
    assert mc.frames(spark, SF).rdd.getNumPartitions() == -(-orders // 50)
    assert mc.kept_frames(spark, SF).rdd.getNumPartitions() == -(-lines // 50)


def reads_lines(name, spark):
    """Whether the query's last step still derives something from the order lines."""
    return any("lineitem" in f for f in catalogue.QUERIES[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["fold_leakage_check", "fold_gate"])
def test_fold_checks_read_frames_once_and_deal_rows(spark, monkeypatch, name):
    want = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
    assert want and not reads_lines(name, spark)
    parts = []
    monkeypatch.setattr(folds, "dealt", lambda *a, **k: parts.append(dealt(*a, **k, rows=100)) or parts[-1])
    assert sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())) == want
    assert parts[0].rdd.getNumPartitions() > 8


@pytest.mark.parametrize("name", ["error_concentration", "horizon_control", "gap_polynomial_control", "proxy_climatology", "boosted_trees", "reconstruction_probe"])
def test_scores_and_fits_read_frames_once(spark, name):
    assert not reads_lines(name, spark)


def test_targets_carry_the_values_of_their_frames(spark):
    rows = [("a", i, day, v) for i, (day, v) in enumerate([(0, 1.0), (90, 2.0), (110, None), (300, 4.0)])]
    f = spark.createDataFrame(rows, "cube string, acq_idx int, day_idx int, v double")
    x = axes.horizon_rows(f, spark.createDataFrame([(100, 30), (200, 15)], "delta int, tol int"), carry=("v",))
    got = sorted((r.acq_idx, r.delta, r.acq_target, r.delta_days, r.v, r.v_target) for r in x.collect())
    assert got == [(0, 100, 1, 90, 1.0, 2.0), (1, 200, 3, 210, 2.0, 4.0), (2, 200, 3, 190, None, 4.0)]


def test_places_of_a_table_are_taken_without_writing_it_again(spark, monkeypatch):
    names = []
    monkeypatch.setattr(ranks, "written", lambda df, name: names.append(name) or written(df, name))
    table = written(spark.range(300).withColumn("k", F.col("id") % 3), "table")
    got = {(r.k, r.id): r.n for r in ranks.row_numbers(table, ["k"], [F.col("id")], "n", rows=20, table=True).collect()}
    assert names == ["ranks"] and got == {(i % 3, i): i // 3 + 1 for i in range(300)}


def test_cells_are_dealt_by_frame_under_their_sky(spark, monkeypatch):
    want = sorted(map(str, catalogue.QUERIES["permuted_cells"](spark, SF).collect()))
    parts = []
    monkeypatch.setattr(fit, "dealt", lambda *a, **k: parts.append(dealt(*a, **k, rows=1000)) or parts[-1])
    assert sorted(map(str, catalogue.QUERIES["permuted_cells"](spark, SF).collect())) == want
    assert parts[0].rdd.getNumPartitions() > 8


def test_common_cells_read_pixels_once(spark):
    assert sum("valid-pixels" in f for f in catalogue.QUERIES["common_masked_cells"](spark, SF).inputFiles()) > 0
