"""The forecast table's disk: folds of few rows send no matrices, no row is written for a frame and fold, shuffle files go with the step that made them."""

import os
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import axes, forecast
from terrafold.operators.fit import grams
from terrafold.operators.ranks import FREED, written

from test_forecast import KEYS, SCHEMA, example, ridge, run


def test_folds_of_few_rows_send_no_matrices(spark, monkeypatch):
    rows = spark.createDataFrame(example(), SCHEMA).withColumn("fold", F.col("cube"))  # a fold a cube
    sent = []
    monkeypatch.setattr(forecast, "grams", lambda src, keys, *a: sent.append((keys, grams(src, keys, *a))) or sent[-1][1])
    few = run(rows)
    assert [x.count() for keys, x in sent if "fold" in keys] == [0]
    monkeypatch.setattr(forecast, "FOLD_ROWS", 5)  # all folds are large now
    sent.clear()
    many = run(rows)
    assert [x.count() for keys, x in sent if "fold" in keys] == [60]
    assert few.keys() == many.keys() and len(few) == 20 * 3 * 6
    for k, r in few.items():
        assert (r.n_train, r.n_test, r.d) == (many[k].n_train, many[k].n_test, many[k].d) and r.sse == pytest.approx(many[k].sse)


def test_a_fold_over_several_batches_is_one(spark):
    import pandas as pd

    pdf = pd.DataFrame({"m": list("aaabbbbb"), "fold": [1, 1, 2, 2, 2, 2, 3, 3], "i": range(8)})
    for size in (1, 3, 8):
        got = [p["i"].tolist() for p in forecast.fold_parts((pdf[i : i + size] for i in range(0, 8, size)), ["m", "fold"])]
        assert got == [[0, 1], [2], [3, 4, 5], [6, 7]]
    assert list(forecast.fold_parts(iter([]), ["m"])) == []


@pytest.mark.parametrize("frames", [forecast.PASS_FRAMES if hasattr(forecast, "PASS_FRAMES") else 1, 9])
def test_skies_are_dealt_by_md5_in_any_number_of_passes(spark, monkeypatch, frames):
    monkeypatch.setattr(forecast, "PASS_FRAMES", frames)
    monkeypatch.setattr(forecast, "RANGE_ROWS", 50)  # several files
    data = example()
    rows = spark.createDataFrame(data, SCHEMA)
    rows = rows.unionByName(rows.withColumn("y", F.col("y") + 1))  # two rows a frame
    got = {(r.delta, r.fold): r for r in forecast.permuted_forecasts(rows, KEYS, "sky", "y", "held", "7").collect()}
    assert len(got) == 12
    for (delta, fold), r in got.items():
        fit = {}
        for side in ("train", "test"):
            part = sorted((x for x in data if x[1] == delta and (x[2] == fold) == (side == "test")), key=lambda x: (x[3], x[4]))
            other = sorted(part, key=lambda x: (md5(f"{x[3]}|{x[4]}|m|{delta}|{fold}|{side}|7".encode()).hexdigest(), x[3], x[4]))
            fit[side] = np.repeat(np.array([x[9] for x in other]), 2, axis=0), np.array([x[7] + i for x in part for i in (0, 1)])
        c, i = ridge(*fit["train"])
        x, y = fit["test"]
        assert (r.n_train, r.n_test) == (len(fit["train"][1]), len(y)) and r.sse == pytest.approx(((y - x @ c - i) ** 2).sum())


def test_no_row_a_frame_and_fold_is_written(spark, monkeypatch):
    rows = spark.createDataFrame(example(), SCHEMA)
    tables = {}
    monkeypatch.setattr(forecast, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    forecast.permuted_forecasts(rows, KEYS, "sky", "y", "held", "7").collect()
    assert {k: t.count() for k, t in tables.items()} == {"permutation-frames": 240, "permutation-folds": 12}
    with pytest.raises(Exception, match="several folds"):
        forecast.permuted_forecasts(rows.unionByName(rows.withColumn("fold", F.col("fold") + 1)), KEYS, "sky", "y", "held", "7").collect()


def test_shuffle_files_go_with_the_table(spark):
    lie = lambda: {f for w in os.walk(spark.conf.get("spark.local.dir")) for f in w[2] if f.startswith("shuffle_")}
    before, was = lie(), spark.conf.get(FREED)
    x = written(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "freed")
    assert not lie() - before and spark.conf.get(FREED) == was and x.count() == 7


def test_levels_of_frames_that_carry_their_pixels(spark):
    pixel = "array<struct<cell:int,ndvi:double>>"
    rows = [([(0, 1.0), (1, 2.0), (2, 5.0), (None, 9.0)], [(0, 4.0), (1, None), (3, 7.0), (None, 1.0)]), ([(0, 1.0), (1, 3.0)], [(1, 5.0), (0, 2.0)]), ([(0, None)], [(0, 1.0)]), ([], [])]
    x = spark.createDataFrame(rows, f"a {pixel}, b {pixel}").select(axes.common_levels("a", "b").alias("l"))
    assert [tuple(r.l) for r in x.collect()] == [(1.0, 4.0), (2.0, 3.5), (None, None), (None, None)]


def test_intervals_bring_no_folds_together(spark):
    from terrafold.operators import metrics

    sums = written(spark.range(300).selectExpr("cast(id % 3 as string) as m", "id as fold", "10L as n", "id * 1.0D as sy", "(50 + id * id)*1.0D as syy", "(5 + id % 7) * 1.0D as sse"), "sums")
    a, b = ({r.m: r for r in metrics.jackknife(sums, ["m"], table=t).collect()} for t in (False, True))
    assert a.keys() == b.keys() == {"0", "1", "2"} and all(tuple(a[m])[1:] == pytest.approx(tuple(b[m])[1:]) for m in a)
    plan = metrics.jackknife(sums, ["m"], table=True)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
