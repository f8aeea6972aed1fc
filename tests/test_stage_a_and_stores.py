"""One training side for curve and ridge, clusters of places, stores and scans."""

import itertools
import random
import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import fit, folds, quality
from terrafold.sources import scan, store

ROWS = "fold int, cube int, doy int, w array<double>, y double"


def stage_rows(seed=0, n=240, folds=4):
    rnd = random.Random(seed)
    return [(i % folds, i % 24, rnd.randint(1, 366), [rnd.gauss(0, 1), rnd.gauss(5, 3), rnd.random()], rnd.gauss(0, 1)) for i in range(n)]


def models(spark, rows, alpha=3.0):
    x = fit.residual_ridge(spark.createDataFrame(rows, ROWS), fit.harmonic_design("doy", 2), "w", "y", "doy", alpha, 5)
    return {r["fold"]: r for r in x.collect()}


def plain(rows, fold, alpha):
    design = lambda d: [1.0] + [f(2 * np.pi * k * d / 365.25) for k in (1, 2) for f in (np.cos, np.sin)]
    train = [r for r in rows if r[0] != fold]
    d, w, y = (np.array(v, float) for v in zip(*((design(r[2]), r[3], r[4]) for r in train)))
    curve = np.linalg.lstsq(d, y, rcond=None)[0]
    a = y - d @ curve
    sd = w.std(0)
    z = (w - w.mean(0)) / sd
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (a - a.mean())) / sd
    icpt = a.mean() - w.mean(0) @ coef
    return curve, coef, icpt, np.std(a - w @ coef - icpt, ddof=1)


def test_residual_ridge_is_the_plain_two_step_fit(spark):
    rows = stage_rows()
    for f, m in models(spark, rows).items():
        curve, coef, icpt, sigma = plain(rows, f, 3.0)
        assert np.allclose(m["curve"], curve, atol=1e-9) and np.allclose(m["coef"], coef, atol=1e-9)
        assert abs(m["intercept"] - icpt) < 1e-9 and abs(m["sigma"] - sigma) < 1e-9 and m["n_train"] == 180


def test_held_out_values_do_not_reach_the_training_side(spark):
    """Poison: whatever stands in the held-out rows of a fold, its models stay as they are."""
    rows = stage_rows()
    poisoned = [(f, c, d, w, y + 100 * w[0] + (1000 if d < 100 else 0)) if f == 0 else (f, c, d, w, y) for f, c, d, w, y in rows]
    a, b = models(spark, rows)[0], models(spark, poisoned)[0]
    for k in ("curve", "coef"):
        assert np.abs(np.subtract(a[k], b[k])).max() < 1e-9
    assert abs(a["intercept"] - b["intercept"]) < 1e-9 and abs(a["sigma"] - b["sigma"]) < 1e-9
    assert np.abs(np.subtract(models(spark, rows)[1]["coef"], models(spark, poisoned)[1]["coef"])).max() > 1


def test_residual_ridge_refuses_too_few_days(spark):
    rows = [(f, c, d % 4, w, y) for f, c, d, w, y in stage_rows()]
    assert models(spark, rows) == {}


def test_summed_arrays(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0]), (2, [1.0, 1.0])], "k int, v array<double>")
    assert {r["k"]: r["v"] for r in fit.summed(x, ["k"], "v").collect()} == {1: [4.0, 7.0], 2: [1.0, 1.0]}


# --- clusters -------------------------------------------------------------------------------------


def linked(points, n):
    """Complete linkage by its definition."""
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > n:
        far = lambda ab: max(np.hypot(*np.subtract(points[i], points[j])) for i in clusters[ab[0]] for j in clusters[ab[1]])
        a, b = min(itertools.combinations(range(len(clusters)), 2), key=far)
        clusters[a] += clusters.pop(b)
    return sorted(sorted(c) for c in clusters)


def blocks(spark, boxes, n, limit=512):
    df = spark.createDataFrame(boxes, "id int, tile string, r0 int, r1 int, c0 int, c1 int")
    out = {}
    for r in folds.spatial_clusters(df, n, limit).collect():
        out.setdefault(r["block"], []).append(r["id"])
    return sorted(sorted(v) for v in out.values()), set(out)


def test_clusters_are_complete_linkage(spark):
    rnd = random.Random(7)
    boxes = [(i, "T", r, r + 128, c, c + 128) for i in range(40) for r, c in [(rnd.randrange(50) * 37, rnd.randrange(50) * 37)]]
    want = linked([((b[2] + b[3]) / 2, (b[4] + b[5]) / 2) for b in boxes], 5)
    assert blocks(spark, boxes, 5)[0] == want
    rnd.shuffle(boxes)
    assert blocks(spark, boxes, 5) == (want, {f"T/block{i}" for i in range(5)})


def test_clusters_beyond_the_limit_and_tiles(spark):
    rnd = random.Random(8)
    boxes = [(i, "T", r, r + 10, c, c + 10) for i in range(300) for r, c in [(rnd.randrange(5000), rnd.randrange(5000))]]
    got, names = blocks(spark, boxes, 6, limit=40)
    assert len(got) == 6 and sorted(i for b in got for i in b) == list(range(300))
    assert blocks(spark, boxes[::-1], 6, limit=40)[0] == got
    with pytest.raises(ValueError):
        blocks(spark, boxes[:3], 6)
    assert blocks(spark, [(1, "A", 0, 1, 0, 1), (2, "B", 0, 1, 0, 1)], 1)[1] == {"A", "B"}


# --- stores ---------------------------------------------------------------------------------------


def embedded(spark, n=6, **changes):
    x = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("cube"), F.lit("enc").alias("encoder"), F.floor(F.col("id") / 2).cast("int").alias("acq_idx"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 2).cast("int")).alias("ts"),
        F.array(*(F.col("id") * F.lit(float(i)) for i in range(4))).alias("vec"), F.lit(0.5).alias("clear_frac"), F.lit(0.0).alias("window_span_days"), F.array_repeat(F.lit(0.5), 16).alias("grid_clear_frac"))
    return x.withColumns(changes)


@pytest.fixture
def place(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/store-{uuid.uuid4().hex}"


def test_embeddings_round_trip(spark, place):
    with pytest.raises(store.NoStoreError):
        store.read_embeddings(spark, place, 4)
    store.write_embeddings(embedded(spark), place, 4)
    store.write_embeddings(embedded(spark, encoder=F.lit("other")), place, 4)
    assert store.read_embeddings(spark, place, 4).count() == 12
    x = store.read_embeddings(spark, place, 4, ["other"])
    assert x.count() == 6 and x.where("encoder <> 'other'").count() == 0
    assert "encoder" in x._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    with pytest.raises(store.NoStoreError):
        store.read_embeddings(spark, place, 4, ["none"])


def test_embeddings_of_other_versions_are_refused(spark, place):
    store.append(embedded(spark), place, 2)
    with pytest.raises(store.SchemaVersionError, match="2"):
        store.read_embeddings(spark, place, 4)
    store.write_embeddings(embedded(spark), place, 4)
    with pytest.raises(store.SchemaVersionError):
        store.read_embeddings(spark, place, 4)
    store.append(embedded(spark), place + "x", None)
    with pytest.raises(store.SchemaVersionError, match="None"):
        store.read_embeddings(spark, place + "x", 4)


def test_embeddings_without_a_field_are_refused(spark, place):
    lacking = embedded(spark).drop("window_span_days")
    with pytest.raises(store.MissingFieldError, match="window_span_days"):
        store.write_embeddings(lacking, place, 4)
    store.append(lacking, place, store.VERSION)
    with pytest.raises(store.MissingFieldError, match="window_span_days"):
        store.read_embeddings(spark, place, 4)


def broken():
    return {
        "length": {"vec": F.array(F.lit(1.0))}, "not_finite": {"vec": F.array(*[F.lit(float("nan"))] * 4)}, "negative_span": {"window_span_days": F.lit(-1.0)}, "span_not_finite": {"window_span_days": F.lit(float("inf"))},
        "not_increasing": {"ts": F.lit("2020-01-01").cast("date")}, "clear_frac_out_of_range": {"clear_frac": F.lit(0.0), "grid_clear_frac": F.array_repeat(F.lit(0.0), 16)},
        "cells": {"grid_clear_frac": F.array_repeat(F.lit(0.5), 15)}, "cell_out_of_range": {"grid_clear_frac": F.concat(F.array(F.lit(1.5), F.lit(-0.5)), F.array_repeat(F.lit(0.5), 14))}, "cell_mean": {"grid_clear_frac": F.array_repeat(F.lit(0.4), 16)},
    }


def test_broken_embeddings_are_refused(spark, place):
    assert quality.embedding_violations(embedded(spark), 4).count() == 0
    for problem, change in broken().items():
        found = {r["problem"] for r in quality.embedding_violations(embedded(spark, **change), 4).collect()}
        assert found == {problem}
    with pytest.raises(store.InvariantError, match="cell_mean"):
        store.write_embeddings(embedded(spark, **broken()["cell_mean"]), place, 4)
    store.append(embedded(spark, **broken()["length"]), place, store.VERSION)
    with pytest.raises(store.InvariantError, match="length"):
        store.read_embeddings(spark, place, 4)


def test_masks_meet_their_frames_without_a_shuffle(spark, place):
    frames = spark.range(50).select(F.col("id").alias("frame_key"), (F.col("id") % 7).alias("cube"), (F.col("id") / 7).cast("int").alias("acq_idx"), F.lit("2020-01-01").cast("date").alias("ts"))
    masks = spark.range(500).select((F.col("id") % 60).alias("frame_key"), (F.col("id") / 60).cast("int").alias("cell"), (F.col("id") % 3 == 0).alias("valid"))
    store.write_masks(frames, masks, place, 4)
    f, m = store.read_masks(spark, place)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = m.join(f, "frame_key")
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = masks.join(frames, "frame_key").select(*x.columns)
        assert x.exceptAll(want).count() == 0 and x.count() == want.count() == masks.where("frame_key < 50").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(store.NoStoreError):
        store.read_masks(spark, place + "x")


def test_scan(spark, place, tmp_path):
    for i, (where, columns) in enumerate({"a": ("nir", "valid"), "b/c": ("B8A", "mask"), "b/d/e": ("nir", "B8A", "mask")}.items()):
        one = spark.createDataFrame([tuple(float(10 * i + j) if c != "mask" and c != "valid" else j % 2 for j, c in enumerate(columns))], ", ".join(f"{c} {'double' if c in ('nir', 'B8A') else 'int'}" for c in columns))
        one.coalesce(1).write.parquet(str(tmp_path / "out"), mode="overwrite")
        (part,) = (tmp_path / "out").glob("part-*.parquet")
        (tmp_path / "root" / where).mkdir(parents=True)
        shutil.copy(part, tmp_path / "root" / where / f"T0{i}_cube.parquet")
    root = str(tmp_path / "root")
    assert [r["path"].rsplit("/", 1)[1] for r in scan.files(spark, root).collect()] == ["T00_cube.parquet", "T01_cube.parquet", "T02_cube.parquet"]
    assert scan.files(spark, root, limit=2).count() == 2
    with pytest.raises(scan.NoFilesError):
        scan.files(spark, root, "*.nc")
    x = scan.cubes(spark, root, {"nir": ("nir", "B8A"), "valid": ("valid", "mask")}, r"/(T\d+)_[^/]*$")
    assert sorted((r["id"], r["nir"], r["valid"]) for r in x.collect()) == [("T00", 0.0, 1), ("T01", 10.0, 1), ("T02", 20.0, 0)]
    with pytest.raises(ValueError, match="swir"):
        scan.cubes(spark, root, {"swir": ("swir", "B11")}, r"/(T\d+)_[^/]*$")
    with pytest.raises(Exception, match="no id in"):
        scan.cubes(spark, root, {"nir": ("nir", "B8A")}, r"/(X\d+)_[^/]*$").collect()
