"""Features brought together by key: the vectors of several encoders in one row, and what the observation process alone would tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .axes import lookback_days

PAIR = ["cube", "acq_idx"]


def assembly_violations(manifest: DataFrame, vectors: DataFrame, encoders: list[str]) -> DataFrame:
    """(cube, acq_idx, encoder, problem): ``missing`` or ``doubled`` pairs of the manifest, and vectors ``not_in_manifest``.

    ``manifest``: one row a (cube, acq_idx); ``vectors``: cube, acq_idx, encoder, vec. A null vector counts as missing; other encoders are not looked at.
    """
    wanted = manifest.select(*PAIR, F.explode(F.array(*map(F.lit, encoders))).alias("encoder"), F.lit(True).alias("_w"))
    held = vectors.where(F.col("encoder").isin(encoders)).groupBy(*PAIR, "encoder").agg(F.count("vec").alias("_n"))
    x = wanted.join(held, [*PAIR, "encoder"], "full_outer")
    n = F.coalesce("_n", F.lit(0))
    problem = F.when(F.col("_w").isNull(), "not_in_manifest").when(n == 0, "missing").when(n > 1, "doubled")
    return x.select(*PAIR, "encoder", problem.alias("problem")).where("problem is not null")


def assembled(manifest: DataFrame, vectors: DataFrame, encoders: list[str]) -> DataFrame:
    """``manifest`` with a column vec_<encoder> for each of ``encoders``; a pair without exactly one vector is an error when the result is read.

    One aggregation brings all encoders of a pair into a row and one join follows, whatever their number. Vectors outside the manifest are left out
    (``assembly_violations`` lists them).
    """
    per = []
    for e in encoders:
        of = F.col("encoder") == e
        per += [F.count(F.when(of, F.col("vec"))).alias(f"_n_{e}"), F.first(F.when(of, F.col("vec")), True).alias(f"vec_{e}")]
    held = vectors.where(F.col("encoder").isin(encoders)).groupBy(*PAIR).agg(*per)
    x = manifest.join(held, PAIR, "left")
    kind = vectors.schema["vec"].dataType
    for e in encoders:
        name = F.concat_ws(" ", F.lit(f"not one vector of {e} for frame"), F.col("cube").cast("string"), F.col("acq_idx").cast("string"))
        x = x.withColumn(f"vec_{e}", F.when(F.col(f"_n_{e}") == 1, F.col(f"vec_{e}")).otherwise(F.raise_error(name).cast(kind)))
    return x.drop(*(f"_n_{e}" for e in encoders))


def observed(frames: DataFrame, context: int = 1, lookback: int = 8) -> DataFrame:
    """(cube, acq_idx, clear_context, window_span_days): clear shares of the last ``context`` frames, oldest first, and the days that ``lookback`` frames span.

    A frame with fewer frames before it than the context needs has no row. ``frames``: cube, acq_idx, day_idx, clear_frac.
    """
    w = Window.partitionBy("cube").orderBy("acq_idx").rowsBetween(-(context - 1), 0)
    x = lookback_days(frames, lookback).withColumn("clear_context", F.collect_list(F.col("clear_frac").cast("double")).over(w))
    return x.where(F.size("clear_context") == context).select(*PAIR, "clear_context", "window_span_days")


def observation_features(rows: DataFrame, frames: DataFrame, context: int = 1, lookback: int = 8) -> DataFrame:
    """``rows`` (cube, acq_idx, acq_target, ...) with ``features``: clear shares of the context, days that the lookback spans, clear share of the target.

    No pixel value and no vector enters, so what a forecast scores on these alone is due to when and how clearly frames were taken.
    A row whose context or target is not among ``frames`` goes.
    """
    target = frames.select("cube", F.col("acq_idx").alias("acq_target"), F.col("clear_frac").cast("double").alias("_c"))
    x = rows.join(observed(frames, context, lookback), PAIR).join(target, ["cube", "acq_target"])
    return x.withColumn("features", F.concat("clear_context", F.array(F.col("window_span_days").cast("double"), "_c"))).drop("clear_context", "window_span_days", "_c")


def observation_cells(rows: DataFrame, frames: DataFrame, cells: DataFrame, lookback: int = 8) -> DataFrame:
    """One row for each of ``rows`` and each cell that both its frames hold, with ``features``: the cell's clear share then, the lookback's days, its clear share at the target.

    ``cells``: cube, acq_idx, cell, clear_frac.
    """
    now = cells.select(*PAIR, "cell", F.col("clear_frac").cast("double").alias("_a"))
    then = cells.select("cube", F.col("acq_idx").alias("acq_target"), "cell", F.col("clear_frac").cast("double").alias("_b"))
    x = rows.join(observed(frames, 1, lookback).drop("clear_context"), PAIR).join(now, PAIR).join(then, ["cube", "acq_target", "cell"])
    return x.withColumn("features", F.array("_a", F.col("window_span_days").cast("double"), "_b")).drop("window_span_days", "_a", "_b")
