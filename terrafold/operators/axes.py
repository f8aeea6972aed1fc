"""Time axes and joins along them: pairs, day windows, as-of horizons, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import written


def consecutive_pairs(frames: DataFrame, *carry: str) -> DataFrame:
    """(cube, acq_a, acq_b, day_a, day_b, gap_days, gap_acq): each frame and its next one; the gap is in days."""
    w = Window.partitionBy("cube").orderBy("acq_idx")
    cols = [F.lead(c).over(w).alias(f"{c}_b") for c in ("acq_idx", "day_idx", *carry)]
    x = frames.select("cube", *(F.col(c).alias(f"{c}_a") for c in ("acq_idx", "day_idx", *carry)), *cols).where(F.col("acq_idx_b").isNotNull())
    return x.withColumn("gap_days", F.col("day_idx_b") - F.col("day_idx_a")).withColumn("gap_acq", F.col("acq_idx_b") - F.col("acq_idx_a"))


def lookback_days(frames: DataFrame, length: int) -> DataFrame:
    """Days from the earliest of the last ``length`` frames to the frame itself."""
    w = Window.partitionBy("cube").orderBy("acq_idx").rowsBetween(-(length - 1), 0)
    return frames.withColumn("window_span_days", F.col("day_idx") - F.first("day_idx").over(w))


def _with_buckets(left: DataFrame, right: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """Range join ``lo <= right.day <= hi`` inside a cube: an equi-join on day buckets, refined."""
    first, last = F.floor(lo / width), F.floor(hi / width)
    x = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(first, last)))
    y = right.withColumn("_b", F.floor(F.col("r_day") / width)).withColumnRenamed("cube", "_c")
    return x.join(y, (F.col("cube") == F.col("_c")) & (x["_b"] == y["_b"]) & F.col("r_day").between(F.col("_lo"), F.col("_hi"))).drop("_c", "_b", "_lo", "_hi")


def window_aggregates(value: str, wet: float = 1.0, base: float = 5.0) -> list[Column]:
    """Aggregates of one variable over a day window."""
    v = F.col(value)
    return [
        F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"), (F.sum(v) / F.count(v)).alias("rate"),
        (F.count_if(v > wet) / F.count(v)).alias("wetfrac"), (F.sum(F.greatest(v - base, F.lit(0.0))) / F.count(v)).alias("gdd_rate"), F.count(v).alias("days_available"),
    ]


def backward_windows(anchors: DataFrame, series: DataFrame, span: int, lag: int = 0, wet: float = 1.0, base: float = 5.0) -> DataFrame:
    """Aggregates over days [p-lag-span+1, p-lag] of the cube, clipped to its start (day 0)."""
    hi = F.greatest(F.col("day") - lag, F.lit(0))
    lo = F.greatest(hi - span + 1, F.lit(0))
    right = series.select("cube", F.col("day").alias("r_day"), "value")
    return _with_buckets(anchors.select("cube", "day"), right, lo, hi, max(1, span)).groupBy("cube", "day").agg(*window_aggregates("value", wet, base))


def horizon_windows(anchors: DataFrame, series: DataFrame, days: int, wet: float = 1.0, base: float = 5.0) -> DataFrame:
    """Aggregates over days [t, t+days]; rows that lack any of the days+1 days go."""
    right = series.select("cube", F.col("day").alias("r_day"), "value")
    x = _with_buckets(anchors.select("cube", "day"), right, F.col("day"), F.col("day") + days, days + 1)
    return x.groupBy("cube", "day").agg(*window_aggregates("value", wet, base)).where(F.col("days_available") == days + 1)


def horizon_rows(frames: DataFrame, settings: DataFrame, context: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """As-of forward join: for each frame and setting (delta, tol) the later frame of the cube nearest to day + delta.

    Ties go to the earlier frame; none within the tolerance, or too few frames before, gives no row.
    ``settings`` is a small table of constants. Columns ``carry`` of ``frames`` come along, those of the later frame as ``<name>_target``.
    """
    targets = [f"{c}_target" for c in carry]
    right = frames.select(F.col("cube").alias("_c"), F.col("acq_idx").alias("acq_target"), F.col("day_idx").alias("day_target"), *(F.col(c).alias(t) for c, t in zip(carry, targets)))
    width = 128
    x = frames.select("cube", "acq_idx", "day_idx", *carry).where(F.col("acq_idx") >= context - 1).join(F.broadcast(settings))
    lo, hi = F.col("day_idx") + F.col("delta") - F.col("tol"), F.col("day_idx") + F.col("delta") + F.col("tol")
    x = x.withColumn("_b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    y = right.withColumn("_b2", F.floor(F.col("day_target") / width))
    x = x.join(y, (F.col("cube") == F.col("_c")) & (F.col("_b") == F.col("_b2")) & F.col("day_target").between(lo, hi) & (F.col("acq_target") > F.col("acq_idx")))
    off = F.abs(F.col("day_target") - F.col("day_idx") - F.col("delta"))
    best = x.groupBy("cube", "acq_idx", "day_idx", "delta", "tol").agg(F.min(F.struct(off.alias("off"), "acq_target", "day_target", *targets)).alias("x"), *(F.first(c).alias(c) for c in carry))  # one left row a group
    return best.select("cube", "acq_idx", "day_idx", "delta", "tol", F.col("x.acq_target").alias("acq_target"), (F.col("x.day_target") - F.col("day_idx")).alias("delta_days"), *carry, *(F.col(f"x.{t}").alias(t) for t in targets))


def retention(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Per horizon: rows, cubes with rows, cubes without any, median rows a cube (of those with rows), share of frames."""
    per = rows.groupBy("delta", "cube").agg(F.count("*").alias("n"))
    total = frames.agg(F.countDistinct("cube").alias("cubes"), F.count("*").alias("frames"))
    x = per.groupBy("delta").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cubes"), F.expr("percentile(n, 0.5)").alias("rows_per_cube"))
    x = x.join(F.broadcast(total))
    return x.select("delta", "n_rows", "n_cubes", (F.col("cubes") - F.col("n_cubes")).alias("n_cubes_none"), "rows_per_cube", (F.col("n_rows") / F.col("frames")).alias("share"))


def common_delta(pairs: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """Change on pixels valid in both frames: mean change and change of the 90th percentile; null if none is shared."""
    a = px.select("cube", F.col("acq_idx").alias("acq_idx_a"), *keys, F.col("ndvi").alias("va")).where("va is not null")
    b = px.select("cube", F.col("acq_idx").alias("acq_idx_b"), *keys, F.col("ndvi").alias("vb")).where("vb is not null")
    both = pairs.join(a, ["cube", "acq_idx_a"]).join(b, ["cube", "acq_idx_b", *keys])
    agg = both.groupBy("cube", "acq_idx_a", "acq_idx_b").agg(
        F.count("*").alias("n_common"), F.avg("va").alias("level_a"), F.avg("vb").alias("level_b"), F.avg(F.col("vb").cast("double") - F.col("va").cast("double")).alias("delta_mean"),
        (F.expr("percentile(vb, 0.9)") - F.expr("percentile(va, 0.9)")).alias("delta_p90"))
    x = pairs.select("cube", "acq_idx_a", "acq_idx_b", "gap_days").join(agg, ["cube", "acq_idx_a", "acq_idx_b"], "left")
    return x.withColumn("n_common", F.coalesce("n_common", F.lit(0)))


def common_cells(pairs: DataFrame, px: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(cube, acq_idx_a, acq_idx_b, cell, n_common, level_a, level_b, delta_mean): levels and change of each cell on its pixels valid in both frames.

    ``px``: cube, acq_idx, the pixel's ``keys`` and ndvi, and its ``cell``. A cell that shares no pixel has no row: nothing is filled.
    Pixels become a table first, since each is read as an earlier and as a later one.
    """
    px = written(px.where("ndvi is not null").select(*dict.fromkeys(["cube", "acq_idx", *keys, cell, "ndvi"])), "valid-pixels")
    a = px.select("cube", F.col("acq_idx").alias("acq_idx_a"), *keys, F.col(cell).alias("_cell"), F.col("ndvi").cast("double").alias("va"))
    b = px.select("cube", F.col("acq_idx").alias("acq_idx_b"), *keys, F.col("ndvi").cast("double").alias("vb"))
    both = pairs.select("cube", "acq_idx_a", "acq_idx_b").distinct().join(a, ["cube", "acq_idx_a"]).join(b, ["cube", "acq_idx_b", *keys])
    return both.groupBy("cube", "acq_idx_a", "acq_idx_b", F.col("_cell").alias("cell")).agg(F.count("*").alias("n_common"), F.avg("va").alias("level_a"), F.avg("vb").alias("level_b"), F.avg(F.col("vb") - F.col("va")).alias("delta_mean"))


def mean_of(values: Column) -> Column:
    """Mean of the numbers of an array that are there; null without any."""
    x = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def common_levels(a: Column | str, b: Column | str) -> Column:
    """(level_a, level_b) on the pixels valid in both frames, whose ``a`` and ``b`` are arrays of pixels (cell, ndvi; a cell once a frame); nulls where they share none.

    ``common_cells`` for frames that carry their pixels in their row, so no pixel is joined.
    """
    held = lambda px: F.filter(px, lambda p: p["cell"].isNotNull() & p["ndvi"].isNotNull())
    of_b = F.map_from_entries(F.transform(held(b), lambda p: F.struct(p["cell"], p["ndvi"])))
    both = F.filter(F.transform(held(a), lambda p: F.struct(p["ndvi"].alias("a"), F.try_element_at(of_b, p["cell"]).alias("b"))), lambda p: p["b"].isNotNull())
    return F.struct(*(mean_of(both[c]).alias(f"level_{c}") for c in ("a", "b")))


def contexts(df: DataFrame, value: str, k: int) -> DataFrame:
    """The last k vectors, oldest first, as one; frames with fewer before them go."""
    w = Window.partitionBy("cube").orderBy("acq_idx").rowsBetween(-(k - 1), 0)
    x = df.withColumn("_ctx", F.collect_list(value).over(w)).where(F.size("_ctx") == k)
    return x.withColumn("context", F.flatten("_ctx")).drop("_ctx")


def lookback_max(df: DataFrame, value: str, length: int) -> DataFrame:
    """Elementwise maximum of the last ``length`` vectors."""
    w = Window.partitionBy("cube").orderBy("acq_idx").rowsBetween(-(length - 1), 0)
    x = df.withColumn("_all", F.collect_list(value).over(w))
    top = F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_all")[0], lambda a, b: F.zip_with(a, b, lambda p, q: F.greatest(p, q)))
    return x.withColumn("pooled", top).drop("_all")


def delta_norms(df: DataFrame, value: str) -> DataFrame:
    """Norm of the difference to the previous vector."""
    w = Window.partitionBy("cube").orderBy("acq_idx")
    x = df.withColumn("_prev", F.lag(value).over(w)).where("_prev is not null")
    diff = F.zip_with(value, "_prev", lambda a, b: a - b)
    return x.withColumn("norm", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))).drop("_prev")


def off_axis(frames: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose day the axis does not have."""
    return frames.join(axis.select(*keys).distinct(), keys, "left_anti")


def exact_days(frames: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` joined with the row of their own day, never with a near one; a frame without its day is an error."""
    if off_axis(frames, axis, keys).head(1):
        raise ValueError("a frame's day is not on the daily axis")
    return frames.join(axis, keys)


def verified_join(joined: DataFrame, source: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(n, n_over, worst): rows compared with the source once more, those that differ by more than the tolerance, the largest difference."""
    x = joined.join(source.select(*keys, F.col(value).alias("_again")), keys).withColumn("_off", F.abs(F.col(value) - F.col("_again")))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("_off") > tolerance).alias("n_over"), F.max("_off").alias("worst"))
