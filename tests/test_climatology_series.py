"""Climatology by whole series: brute force through small Arrow batches, and no row a day on the way to an anomaly."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import climatology


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # series span batches
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def series():
    rng = random.Random(11)
    out = []
    for k in range(5):
        days = sorted({dt.date(y, 1, 1) + dt.timedelta(rng.choice([rng.randrange(365), rng.randrange(12), 353 + rng.randrange(12)])) for y in (1999, 2000, 2001, 2004) for _ in range(1 + 4 * k)})
        out += [(k, f"c{k % 2}", d, None if rng.random() < 0.3 else rng.random()) for d in days]
    return out + [(None, "c0", dt.date(2000, 1, 1), 1.0), (0, "c0", None, 1.0)]


def brute(rows):
    """(k, excluded, doy): the centred mean of 30 days."""
    out = {}
    for k in range(5):
        mine = sorted((d, v) for q, _, d, v in rows if q == k and d)
        for e in {d.year for d, _ in mine}:
            kept, days = [(d, v) for d, v in mine if d.year != e], {}
            for i, (d, v) in enumerate(kept):
                if v is None:
                    a, b = [x for x in kept[:i] if x[1] is not None][-1:], [x for x in kept[i:] if x[1] is not None][:1]
                    if not a or not b:
                        continue
                    v = a[0][1] + (b[0][1] - a[0][1]) * (d - a[0][0]).days / (b[0][0] - a[0][0]).days
                days.setdefault(d.timetuple().tm_yday, []).append(v)
            for s in range(1, 367):
                near = [sum(w) / len(w) for day, w in days.items() if any((day + o - 1) % 366 + 1 == s for o in range(-14, 16))]
                if near:
                    out[k, e, s] = sum(near) / len(near)
    return out


def test_series_against_brute_force(spark, small_batches):
    rows = series()
    df, want = spark.createDataFrame(rows, "k int, c string, ts date, value double").repartition(3), brute(rows)
    got = {(r.k, r.excluded, r.doy): r.clim for r in climatology.leave_year_out(df, ["k", "c"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in got)
    got = {(r.k, r.excluded): (r.n, r.total) for r in climatology.leave_year_out_totals(df, ["k", "c"], ["c"]).collect()}
    for k, e in {x[:2] for x in want}:
        mine = [v for x, v in want.items() if x[:2] == (k, e)]
        assert got.pop((k, e)) == (len(mine), pytest.approx(sum(mine)))
    assert not got
    got = {(r.k, r.ts): r.anomaly for r in climatology.anomalies(df, ["k", "c"]).collect()}
    plain = {(k, d): v - want[k, d.year, d.timetuple().tm_yday] for k, _, d, v in rows if k is not None and d and v is not None and (k, d.year, d.timetuple().tm_yday) in want}
    assert got.keys() == plain.keys() and len(got) > 50 and all(math.isclose(got[x], plain[x], abs_tol=1e-12) for x in got)


def test_anomalies_need_one_shuffle_and_no_row_a_day(spark, small_batches):
    df = spark.createDataFrame(series(), "k int, c string, ts date, value double").withColumn("acq_idx", F.lit(0)).withColumn("cube", F.col("k"))
    sides = spark.createDataFrame([(1, 0, 0, "train"), (2, 0, 0, "test")], "cube int, acq_idx int, fold int, side string")
    for x in (climatology.anomalies(df, ["k", "c"]), climatology.strict_anomalies(df.join(climatology.sides_by_frame(sides), ["cube", "acq_idx"], "left"), ["cube", "c"], {0: {1999, 2000}})):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan
        assert x.count() > 0
