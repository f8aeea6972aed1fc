"""Checks as operators: each returns the violations it finds as a table (problem, keys or counts); an empty table means that all holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mask import finite


def _counted(df: DataFrame, keys: list[str], problems: dict[str, Column]) -> DataFrame:
    """(keys, problem, n): rows that have each problem."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in problems.items()))
    x = df.select(*keys, F.explode(found).alias("problem")).where("problem is not null")
    return x.groupBy(*keys, "problem").agg(F.count("*").alias("n"))


def require(violations: DataFrame, error: type[Exception] = ValueError) -> None:
    """Raise with the first few violations, if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise error("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def manifest_violations(df: DataFrame, constant: list[str]) -> DataFrame:
    """(cube, problem, n): repeated (cube, ts), and columns that should not vary inside a cube but do."""
    twice = duplicates(df, ["cube", "ts"]).groupBy("cube").agg(F.count("*").alias("n")).select("cube", F.lit("ts_repeated").alias("problem"), "n")
    per = df.groupBy("cube").agg(*(F.countDistinct(c).alias(c) for c in constant))
    out = twice
    for c in constant:
        out = out.unionByName(per.where(F.col(c) > 1).select("cube", F.lit(f"{c}_varies").alias("problem"), F.col(c).alias("n")))
    return out


def year_mismatches(df: DataFrame) -> DataFrame:
    """(cube, problem, n): rows whose year column is not the year of their timestamp."""
    return _counted(df, ["cube"], {"year_differs": F.col("year") != F.year("ts")})


def strata_missing(df: DataFrame, stratum: str) -> DataFrame:
    """(problem, n): rows without a stratum, by reason."""
    s = F.col(stratum)
    x = df.select(F.when(s.isNull(), "null").when(s.startswith("ABSENT:"), s).alias("problem")).where("problem is not null")
    return x.groupBy("problem").agg(F.count("*").alias("n"))


def cell_violations(df: DataFrame, features: list[str], cells: int = 16) -> DataFrame:
    """(problem, n): cell numbers out of range, repeated (frame, cell), frames with too many cells, frame-level features that vary inside a frame."""
    frame = df.groupBy("cube", "acq_idx").agg(
        F.count("*").alias("rows"), F.countDistinct("cell").alias("cells"), F.count_if(~F.col("cell").between(0, cells - 1)).alias("out"), *(F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(f"_{c}") for c in features)
    )
    problems = {"cell_out_of_range": F.col("out") > 0, "cell_repeated": F.col("rows") > F.col("cells"), "too_many_cells": F.col("cells") > cells}
    return _counted(frame, [], problems | {f"{c}_varies": F.col(f"_{c}") > 0 for c in features})


def vector_violations(df: DataFrame, vec: str, size: int, apart: list[str] | None = None) -> DataFrame:
    """(problem, n): vectors of another length or with components that are not finite, negative spans, times that do not increase inside a cube (and the columns ``apart``)."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("cube", *apart or []).orderBy("acq_idx"))
    x = df.withColumn("_before", before)
    return _counted(x, [], {"length": F.size(vec) != size, "not_finite": F.exists(vec, lambda v: ~finite(v)), "negative_span": F.col("span") < 0, "not_increasing": F.col("ts") <= F.col("_before")})


def embedding_violations(df: DataFrame, size: int, cells: int = 16) -> DataFrame:
    """(problem, n): what rows of an embedding store must not have: see ``vector_violations``, spans by ``window_span_days``; clear fractions outside (0, 1]; where
    there are cells: another number of them, fractions outside [0, 1], and a mean that is not the frame's."""
    x = df.withColumn("span", F.col("window_span_days"))
    clear = F.col("clear_frac")
    problems = {"clear_frac_out_of_range": ~finite("clear_frac") | (clear <= 0) | (clear > 1), "span_not_finite": ~finite("span")}
    if "grid_clear_frac" in df.columns:
        grid = F.col("grid_clear_frac")
        mean = F.aggregate(grid, F.lit(0.0), lambda a, b: a + b) / F.size(grid)
        problems |= {"cells": F.size(grid) != cells, "cell_out_of_range": F.exists(grid, lambda v: ~finite(v) | (v < 0) | (v > 1)), "cell_mean": grid.isNotNull() & (F.abs(mean - clear) > 1e-6)}
    return vector_violations(x, "vec", size, ["encoder"]).unionByName(_counted(x, [], problems))


def lookback_violations(df: DataFrame, least: int = 3) -> DataFrame:
    """(encoder, problem, n): encoders of several images whose lookback hardly varies, and of one image with a lookback."""
    x = df.groupBy("encoder", "window_len").agg(F.countDistinct("span").alias("values"), F.max(F.abs("span")).alias("top"), F.count("*").alias("rows"))
    problem = F.when((F.col("window_len") > 1) & (F.col("values") < least), "uninformative").when((F.col("window_len") == 1) & (F.col("top") > 0), "single_image_with_span")
    return x.withColumn("problem", problem).where("problem is not null").select("encoder", "problem", F.col("values").alias("n"))


def controls_differ(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n): controls that are not the same in every view (a null counts as a value of its own)."""
    kept = F.count_if(F.col(value).isNull()) > 0
    x = scores.where("is_control").groupBy(*keys).agg((F.countDistinct(value) + kept.cast("int")).alias("n"))
    return x.where("n > 1")


def effective_n_violations(results: DataFrame) -> DataFrame:
    """(config, problem): effective_n that is not the sum over folds, or more than there are cubes."""
    total = F.aggregate(F.col("per_fold"), F.lit(0).cast("long"), lambda a, b: a + b)
    problem = F.when(F.col("effective_n") != total, "not_the_sum_of_folds").when(F.col("effective_n") > F.col("n_cubes"), "more_than_cubes")
    return results.withColumn("problem", problem).where("problem is not null").select("config", "problem")


def multi_image_flags(results: DataFrame) -> DataFrame:
    """(model, problem): rows of encoders that see several images must be flagged, use one context and stay out of rankings."""
    many = F.col("window_len") > 1
    problem = F.when(many & ~F.col("flagged"), "not_flagged").when(many & (F.col("context") > 1), "several_contexts").when(many & F.col("ranked"), "ranked")
    return results.withColumn("problem", problem).where("problem is not null").select("model", "problem")


def label_violations(results: DataFrame, labels: dict[str, str], stages: list[str]) -> DataFrame:
    """(stage, problem, n): climatology labels that are not exactly those of their stage, and stages that neither ran nor were deferred."""
    want = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("stage")]
    wrong = _counted(results, ["stage"], {"wrong_label": ~F.coalesce(F.col("climatology_def") == want, F.lit(False))})
    seen = results.select("stage").distinct()
    asked = results.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return wrong.unionByName(asked.join(seen, "stage", "left_anti").select("stage", F.lit("not_run").alias("problem"), F.lit(0).cast("long").alias("n")))


def verdict_violations(verdicts: DataFrame, models: DataFrame) -> DataFrame:
    """(model, problem): models without a verdict, and verdicts that their margin contradicts (null margin: baseline)."""
    want = F.when(F.col("margin").isNull(), "baseline").when(F.col("margin") >= 0, "passed").otherwise("lossy")
    x = models.join(verdicts, "model", "left").withColumn("problem", F.when(F.col("verdict").isNull(), "no_verdict").when(F.col("verdict") != want, "contradicts_margin"))
    return x.where("problem is not null").select("model", "problem")


def partition_violations(groups: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """(name, n): members that the groups do not cover exactly once."""
    x = members.select(name).distinct().join(groups.groupBy(name).agg(F.count("*").alias("n")), name, "full_outer")
    return x.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n <> 1")


def primary_row(results: DataFrame, **config) -> DataFrame:
    """The one row of a configuration; none or several are an error."""
    x = results
    for k, v in config.items():
        x = x.where(F.col(k) == v)
    n = x.count()
    if n != 1:
        raise ValueError(f"{n} rows for {config}")
    return x
