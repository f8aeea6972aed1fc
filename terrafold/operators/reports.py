"""Reports over frames, horizons and scores: collinearity, identifiability, retention, bins, agreement of rankings and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


def collinearity(df: DataFrame, doy: str, value: str) -> DataFrame:
    """How far a day-of-year alone explains a variable: distinct days, their span, rows that share a day, spread inside days over total spread."""
    per = df.where(F.col(value).isNotNull()).groupBy(doy).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    inside = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    ratio = F.sqrt(F.greatest(inside, F.lit(0.0)) / F.nullif(F.greatest(total, F.lit(0.0)), F.lit(0.0)))
    return per.agg(F.count("*").alias("n_days"), (F.max(doy) - F.min(doy)).alias("span"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_shared"), ratio.alias("within_share"))


def feature_collinearity(df: DataFrame, doy: str, vec: str, step: int = 5) -> DataFrame:
    """One row: how much of many features (``vec``) the day of year alone tells. Distinct days, their span, whether all lie ``step`` days apart (one lattice), rows
    that share a day, and least, median and largest of the features' spread inside days over their total spread (null for a constant feature).

    Rows with a null day, vector or component take no part; without rows all but the counts are null.
    """
    x = df.where(F.col(doy).isNotNull() & F.col(vec).isNotNull()).where(F.forall(vec, lambda v: v.isNotNull()))
    x = x.select(F.col(doy).alias("_d"), F.posexplode(vec).alias("_f", "_v")).groupBy("_f", "_d").agg(F.count("*").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v"))
    # the spread of all rows is that inside days and that of the days' means
    inside = F.sum(F.col("n") * F.col("v"))
    centre = x.groupBy("_f").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_c"))
    per = x.join(F.broadcast(centre), "_f")  # a row a feature
    between = F.sum(F.col("n") * (F.col("m") - F.col("_c")) * (F.col("m") - F.col("_c")))
    shares = per.groupBy("_f").agg(F.sqrt(inside / F.nullif(inside + between, F.lit(0.0))).alias("share")).agg(
        F.min("share").alias("share_min"), F.percentile("share", 0.5).alias("share_median"), F.max("share").alias("share_max"))
    days = x.where("_f = 0").agg(F.count("*").alias("n_days"), (F.max("_d") - F.min("_d")).alias("span"), (F.min(F.col("_d") % step) == F.max(F.col("_d") % step)).alias("one_lattice"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("n_shared"))
    return days.join(F.broadcast(shares))  # one row each


def chance(df: DataFrame, keys: list[str], label: str, known: int) -> DataFrame:
    """(keys, n, n_classes, n_missing, majority_class, majority_share, balanced_accuracy, macro_f1): what naming the commonest class (ties: the least) scores.

    Of ``known`` classes only those that occur count: balanced accuracy 1 / K, macro-F1 2p / (1 + p) / K for a majority share p. Rows without a label take no part.
    """
    per = df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    x = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("n_classes"), F.min(F.struct((-F.col("_n")).alias("m"), F.col("_l").alias("l"))).alias("_top"))
    p = -F.col("_top.m") / F.col("n")
    return x.select(*keys, "n", "n_classes", (F.lit(known) - F.col("n_classes")).alias("n_missing"), F.col("_top.l").alias("majority_class"), p.alias("majority_share"), (1 / F.col("n_classes")).alias("balanced_accuracy"), (2 * p / (1 + p) / F.col("n_classes")).alias("macro_f1"))


def identifiability(rows: DataFrame, keys: list[str], doy: str, order: int) -> DataFrame:
    """(keys, n_doy, identifiable): whether each key has days enough for a harmonic curve of that order."""
    x = rows.groupBy(*keys).agg(F.countDistinct(doy).alias("n_doy"))
    return x.withColumn("identifiable", F.col("n_doy") >= 2 * order + 1)


def retention_details(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(delta, n_rows, n_doy, long): distinct target days of each horizon, and whether it is half the median span of a cube or more.

    ``spans`` has one row (median_span). A long horizon must keep fewer rows than the next shorter one.
    """
    x = rows.groupBy("delta").agg(F.count("*").alias("n_rows"), F.countDistinct("doy_target").alias("n_doy"))
    return x.join(F.broadcast(spans.select("median_span"))).withColumn("long", F.col("delta") >= 0.5 * F.col("median_span"))


def not_shrinking(details: DataFrame) -> DataFrame:
    """(delta, n_rows): long horizons that keep no fewer rows than the next shorter horizon."""
    from pyspark.sql import Window

    x = details.withColumn("_before", F.lag("n_rows").over(Window.orderBy("delta")))  # one row a horizon
    return x.where("long and n_rows >= _before").select("delta", "n_rows")


def multi_year(frames: DataFrame) -> DataFrame:
    """(cube, n_years, multi_year)."""
    x = frames.groupBy("cube").agg(F.countDistinct(F.year("ts")).alias("n_years"))
    return x.withColumn("multi_year", F.col("n_years") > 1)


def r2_within(df: DataFrame, keys: list[str], y: str, pred: str, least: int = 20) -> DataFrame:
    """(keys, n, r2): pooled R2 inside each bin or stratum, null under ``least`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), metrics.r2(y, pred, least).alias("r2"))


def skill(sse: Column, reference: Column) -> Column:
    """1 - SSE / reference SSE; null without reference error."""
    return 1 - sse / F.nullif(reference, F.lit(0.0))


def rank_agreement(scores: DataFrame, mode: str, item: str, value: str, a: str, b: str) -> DataFrame:
    """(rho, n): Spearman correlation of items' scores between two modes."""
    x = scores.groupBy(item).pivot(mode, [a, b]).agg(F.avg(value)).withColumn("_k", F.lit(0))
    return metrics.spearman(x, ["_k"], a, b).select("rho", "n")


def all_margins(scores: DataFrame, keys: list[str], value: str, controls: list[str]) -> DataFrame:
    """``scores`` of the other models with a margin over each control: columns margin_<control>, null where the control has no score."""
    c = scores.where(F.col("model").isin(controls)).groupBy(*keys).pivot("model", controls).agg(F.first(value))
    x = scores.where(~F.col("model").isin(controls)).join(c, keys, "left")
    return x.select(*scores.columns, *((F.col(value) - F.col(m)).alias(f"margin_{m}") for m in controls))


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_a, mean_b, overlap, b_inside): two results' intervals side by side."""
    x = a.select(*keys, F.col("mean").alias("mean_a"), F.col("ci_lo").alias("lo_a"), F.col("ci_hi").alias("hi_a")).join(b.select(*keys, F.col("mean").alias("mean_b"), F.col("ci_lo").alias("lo_b"), F.col("ci_hi").alias("hi_b")), keys)
    overlap = (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    return x.select(*keys, "mean_a", "mean_b", overlap.alias("overlap"), F.col("mean_b").between(F.col("lo_a"), F.col("hi_a")).alias("b_inside"))


def validation(scores: DataFrame, value: str, control: str, proxy: str, real: str) -> DataFrame:
    """(stage, model, k, mean, ci_lo, ci_hi, margin, mde, folds_needed, proxy_minus_real, overlap): a stand-in held against what it stands in for.

    ``scores``: stage, model, fold, ``value``. ``margin`` is over the stage's ``control`` (null for itself); ``mde`` is the least effect that the stage's folds
    show at 5 % and 80 % power, ``folds_needed`` how many would show the mean itself. ``overlap`` says whether the two stages' intervals meet: if they do, the
    folds cannot tell them apart, which does not make them equal. A model that one stage lacks has neither difference nor overlap.
    """
    t = metrics.t_interval(scores, ["stage", "model"], value)
    c = t.where(F.col("model") == control).select("stage", F.col("mean").alias("_c"))
    both = interval_overlap(t.where(F.col("stage") == proxy), t.where(F.col("stage") == real), ["model"])
    both = both.select("model", (F.col("mean_a") - F.col("mean_b")).alias("proxy_minus_real"), "overlap")
    reach = metrics.POWER * F.col("std")
    x = t.join(c, "stage", "left").join(both, "model", "left")
    return x.select("stage", "model", "k", "mean", "ci_lo", "ci_hi", F.when(F.col("model") != control, F.col("mean") - F.col("_c")).alias("margin"), (reach / F.sqrt("k")).alias("mde"),
                    F.ceil(F.pow(reach / F.nullif(F.abs("mean"), F.lit(0.0)), 2)).alias("folds_needed"), "proxy_minus_real", "overlap")


def bookkeeping(fold_scores: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """(keys, n_folds, n_empty, n_null, d_over_n): folds, those without test rows, those without a score, and parameters over the least training rows."""
    return fold_scores.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.count_if(F.col("n_test") == 0).alias("n_empty"), F.count_if(F.col(value).isNull()).alias("n_null"), (F.lit(float(size)) / F.min("n_train")).alias("d_over_n")
    )


def majority_dummy(rows: DataFrame, folds: DataFrame, label: str) -> DataFrame:
    """(fold, label): the most frequent class of each fold's training side (the least of a tie)."""
    x = rows.join(folds.where("side = 'train'"), ["cube", "acq_idx"]).groupBy("fold", label).agg(F.count("*").alias("n"))
    return x.groupBy("fold").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("x")).select("fold", F.col("x.label").alias("label"))


def class_name(code: str, names: dict[int, str]) -> Column:
    """The class of a code; ``unknown_<code>`` for others."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col(code)], F.concat(F.lit("unknown_"), F.col(code).cast("string")))


def pooled_grid(vec: str, side: int, cells: int) -> Column:
    """A square map of side * side values (row after row) as the means of cells * cells blocks."""
    step = side // cells
    mean = lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(step * step - 1)), lambda i: F.get(vec, (c / cells).cast("int") * step * side + (i / step).cast("int") * side + (c % cells) * step + i % step)), F.lit(0.0), lambda a, b: a + b) / (step * step)
    return F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), mean)


def without_sentinels(columns: list[str]) -> tuple[list[Column], Column]:
    """The columns with 0 for what is not finite, and how many values that replaced in a row."""
    from .mask import finite

    n = F.lit(0)
    for c in columns:
        n = n + F.when(finite(c), 0).otherwise(1)
    return [F.when(finite(c), F.col(c)).otherwise(0.0).alias(c) for c in columns], n


def complete_variables(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n_missing, kept): a variable with any missing or non-finite value is dropped, not filled."""
    from .mask import finite

    counts = df.agg(*(F.count_if(~finite(c)).alias(c) for c in columns))
    x = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing")) for c in columns))).alias("x")).select("x.*")
    return x.withColumn("kept", F.col("n_missing") == 0)
