"""Climatology in crossed folds: strict targets against brute force, and what held-out years can reach."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import climatology

OBS = "cube long, cell int, acq_idx long, ts date, value double"


def example(spark):
    rng = random.Random(3)
    obs, sides = [], []
    for cube in range(4):
        days = sorted({dt.date(y, 1, 1) + dt.timedelta(rng.randrange(365)) for y in (2000, 2001, 2002, 2003) for _ in range(12)})
        for i, day in enumerate(days):
            for cell in (0, 1):
                obs.append((cube, cell, i, day, None if rng.random() < 0.2 else rng.random()))
            for fold in (0, 1):
                c, y = cube % 2 == fold, day.year % 2 == fold
                if c == y:
                    sides.append((cube, i, fold, "test" if c else "train"))
    return obs, sides, spark.createDataFrame(sides, "cube long, acq_idx long, fold int, side string")


def brute(obs, sides):
    side = {(c, i, f): s for c, i, f, s in sides}
    out = {}
    for fold in (0, 1):
        train = {t.year for c, _, i, t, _ in obs if side.get((c, i, fold)) == "train"}
        for cube, cell, i, t, v in obs:
            s = side.get((cube, i, fold))
            if s is None or v is None:
                continue
            years = train - {t.year} if s == "train" else train
            series = sorted((u, w) for c, e, _, u, w in obs if (c, e) == (cube, cell) and u.year in years)
            days = {}
            for j, (u, w) in enumerate(series):
                if w is None:
                    a, b = [x for x in series[:j] if x[1] is not None][-1:], [x for x in series[j:] if x[1] is not None][:1]
                    if not a or not b:
                        continue
                    w = a[0][1] + (b[0][1] - a[0][1]) * (u - a[0][0]).days / (b[0][0] - a[0][0]).days
                days.setdefault(u.timetuple().tm_yday, []).append(w)
            at = t.timetuple().tm_yday
            near = [sum(w) / len(w) for day, w in days.items() if any((day + o - 1) % 366 + 1 == at for o in range(-14, 16))]
            if near:
                out[cube, cell, i, fold, s] = v - sum(near) / len(near)
    return out


def read(df):
    return {(r.cube, r.cell, r.acq_idx, r.fold, r.side): r.anomaly for r in df.collect()}


def test_strict_anomalies_against_brute_force_and_poison(spark):
    obs, sides, table = example(spark)
    df = spark.createDataFrame(obs, OBS)
    got, want = read(climatology.crossed_anomalies(df, ["cube", "cell"], table, True)), brute(obs, sides)
    assert got.keys() == want.keys() and len(got) > 100 and {k[4] for k in got} == {"train", "test"}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    # fold 0 holds out even years: what lies there reaches none of its training targets in strict mode, and does in the other
    poison = df.withColumn("value", F.when(F.year("ts") % 2 == 0, F.col("value") * 100).otherwise(F.col("value")))
    train = lambda x: {k: v for k, v in x.items() if k[3] == 0 and k[4] == "train"}
    assert train(read(climatology.crossed_anomalies(poison, ["cube", "cell"], table, True))) == pytest.approx(train(got), abs=1e-12)
    plain = train(read(climatology.crossed_anomalies(df, ["cube", "cell"], table, False)))
    bad = train(read(climatology.crossed_anomalies(poison, ["cube", "cell"], table, False)))
    assert plain.keys() == bad.keys() and max(abs(plain[k] - bad[k]) for k in plain) > 1


def test_edges(spark):
    _, _, table = example(spark)
    none = spark.createDataFrame([], OBS)
    assert climatology.crossed_anomalies(none, ["cube", "cell"], table, True).count() == 0
    # one training year: no other year to compare a training row with, so only test rows have an anomaly
    two = spark.createDataFrame([(0, 0, 0, dt.date(2000, 5, 1), 1.0), (1, 0, 0, dt.date(2001, 5, 3), 2.0), (0, 0, 1, dt.date(2001, 5, 2), 4.0), (0, 0, 2, dt.date(2000, 5, 1), None)], OBS)
    fold = spark.createDataFrame([(0, 0, 0, "test"), (0, 2, 0, "test"), (1, 0, 0, "train")], "cube long, acq_idx long, fold int, side string")
    assert read(climatology.crossed_anomalies(two, ["cube", "cell"], fold, True)) == {(0, 0, 0, 0, "test"): -3.0}
