"""Space-time views over plain tables: frames, pixels, daily series, footprints, vectors.

A cube is a customer, a frame one of its order dates, a pixel an order line (its line number is the grid
cell), a band pair price and quantity. Explicit columns, no positional access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mask
from ..operators.ranks import dealt

CLEAR, SCENE = ("A", "N"), ("O", "F")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_present(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of ``names`` that ``df`` has; an error names what was looked for."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} among {df.columns}")


def parsed_id(name: Column) -> Column:
    """(tile, start, end, start_year, r0, r1, c0, c1) of a cube id ``tile_start_end_r0_r1_c0_c1``; any other form is an error."""
    p = F.split(name, "_")
    whole = F.when(F.size(p) == 7, p).otherwise(F.raise_error(F.concat(F.lit("not a cube id: "), name)).cast("array<string>"))
    at = lambda i: F.get(whole, F.lit(i))
    start, end = at(1).cast("date"), at(2).cast("date")
    return F.struct(at(0).alias("tile"), start.alias("start"), end.alias("end"), F.year(start).alias("start_year"), *(at(3 + i).cast("long").alias(c) for i, c in enumerate(("r0", "r1", "c0", "c1"))))


def with_axes(frames: DataFrame, cube: str = "cube", ts: str = "ts", key: str = "frame_key") -> DataFrame:
    """Keep the first row of each (cube, time), then number acquisitions and days from the cube's start."""
    first = Window.partitionBy(cube, ts).orderBy(key)
    order = Window.partitionBy(cube).orderBy(ts)
    x = frames.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return x.withColumn("acq_idx", F.row_number().over(order) - 1).withColumn("day_idx", F.date_diff(ts, F.first(ts).over(order)))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cube, ts, frame_key, acq_idx, day_idx): every acquisition."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cube"), F.to_date("o_orderdate").alias("ts"), F.col("o_orderkey").alias("frame_key"))
    return with_axes(dealt(o, ["cube"]))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_key, cell, nir, red, valid, ndvi): one row per frame and cell; a frame lies in one partition, so what groups or joins by frames shuffles no more."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_key"), (F.col("l_linenumber") - 1).alias("cell"), (F.col("l_extendedprice") / 1000).alias("nir"), F.col("l_quantity").alias("red"),
        mask.clear_sky("l_returnflag", CLEAR, "l_linestatus", SCENE).alias("valid"))
    px = dealt(li, ["frame_key"]).groupBy("frame_key", "cell").agg(F.avg("nir").alias("nir"), F.avg("red").alias("red"), F.min("valid").alias("valid"))
    return px.withColumn("ndvi", mask.ndvi("nir", "red", "valid"))


def cube_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).join(pixels(spark, sf_dir), "frame_key")


def kept_frames(spark: SparkSession, sf_dir: str, min_clear: float = 0.5, *more: Column) -> DataFrame:
    """Frames that are clear enough, with statistics of the masked index (positions count all acquisitions) and ``more`` of their pixels."""
    px = mask.clear_fraction(pixels(spark, sf_dir), ["frame_key"], F.avg("ndvi").alias("mean_ndvi"), F.expr("percentile(ndvi, 0.9)").alias("p90_ndvi"), *more)
    return frames(spark, sf_dir).join(mask.select_clear(px, min_clear), "frame_key")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cube, day, value, rain): a daily series per user of the event table, without gaps filled."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("cube"), F.to_date("ts").alias("date"), "value")
    e = e.groupBy("cube", "date").agg(F.avg("value").alias("value"))
    return e.withColumn("day", F.date_diff("date", F.lit("2024-01-01").cast("date")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cube, acq_idx, vec_id, vec, label)."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("cube"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    return e.withColumn("acq_idx", F.row_number().over(Window.partitionBy("cube").orderBy("vec_id")) - 1)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, r0, r1, c0, c1): boxes derived from customer keys."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("grp"), (k * 37 % 5000).alias("r0"), (k * 91 % 7000).alias("c0"))
    return c.withColumn("r1", F.col("r0") + 128).withColumn("c1", F.col("c0") + 128)
