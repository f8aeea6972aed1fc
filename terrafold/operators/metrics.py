"""Scores, intervals, verdicts and completeness over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import RANGE_ROWS, counted, percentiles_by, running, written

#: fixed values: two-sided 95 % t quantiles by degrees of freedom, from 1
T95 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852)

#: fixed values: normal quantiles of 5 % (two-sided) and of 80 % power, together
POWER = 1.959964 + 0.841621


def t95(dof: Column) -> Column:
    """The quantile of any number of degrees of freedom: from the table, and beyond it by the series in 1 / dof from the normal one (within 5e-6)."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    series = F.lit(z)
    for i, c in enumerate(terms, 1):
        series = series + F.lit(c) / F.pow(dof, F.lit(i))
    return F.when(dof.between(1, len(T95)), F.element_at(F.array(*map(F.lit, T95)), F.greatest(F.least(dof, F.lit(len(T95))), F.lit(1)).cast("int"))).when(dof > len(T95), series)


def r2(y: str, pred: str, least: int = 8) -> Column:
    """1 - SSE/SST; null under ``least`` rows or without spread."""
    e, v = F.col(y) - F.col(pred), F.col(y)
    sst = F.sum(v * v) - F.sum(v) * F.sum(v) / F.count(v)
    return F.when((F.count(v) >= least) & (sst > 1e-12), 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0)))


def rmse(y: str, pred: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3, rows: int = RANGE_ROWS) -> DataFrame:
    """Rank correlation with average ranks; null for a constant side or under ``least`` rows. Equal pairs are one row with a weight, and ranks are taken in ranges."""
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_w")), "spearman-pairs")
    spread = pairs
    for side, rank in (("_x", "_a"), ("_y", "_b")):
        once = pairs.groupBy(*keys, side).agg(F.sum("_w").alias("_m"))
        upto = running(once, keys, [F.col(side)], {"_upto": F.col("_m")}, rows)
        spread = spread.join(upto.select(*keys, side, (F.col("_upto") - (F.col("_m") - 1) / 2.0).alias(rank)), [*keys, side])
    w, a, b = F.col("_w"), F.col("_a"), F.col("_b")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    va, vb = F.sum(w * a * a) - sa * sa / n, F.sum(w * b * b) - sb * sb / n
    rho = (F.sum(w * a * b) - sa * sb / n) / F.nullif(F.sqrt(va * vb), F.lit(0.0))
    return spread.groupBy(*keys).agg(F.when((n >= least) & (va > 0) & (vb > 0), rho).alias("rho"), n.alias("n"))


def class_scores(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """Balanced accuracy and macro-F1 over the classes present in ``y``, chance level and majority share."""
    hit = F.col(y) == F.col(pred)
    truth = df.groupBy(*keys, F.col(y).alias("_c")).agg(F.count("*").alias("n"), F.count_if(hit).alias("tp"))
    guess = df.groupBy(*keys, F.col(pred).alias("_c")).agg(F.count("*").alias("p"))
    x = truth.join(guess, [*keys, "_c"], "left")
    f1 = 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))
    return x.groupBy(*keys).agg(F.avg(F.col("tp") / F.col("n")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (1 / F.count("*")).alias("chance"), (F.max("n") / F.sum("n")).alias("majority"))


def t_interval(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, range and 95 % t interval over folds."""
    n = F.count(value)
    x = scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), n.alias("k"), t95(n - 1).alias("_t"))
    half = F.col("_t") * F.col("std") / F.sqrt("k")
    return x.withColumn("ci_lo", F.col("mean") - half).withColumn("ci_hi", F.col("mean") + half).drop("_t")


def jackknife(sums: DataFrame, keys: list[str], table: bool = False) -> DataFrame:
    """Pooled 1 - SSE/SST of (keys, fold, n, sy, syy, sse), with its delete-one-fold interval: totals minus each fold's own sums.

    ``table``: ``sums`` only reads a table, and its keys are few and never null; it is then read twice, and its folds, which may be as many as there are cubes, are not brought together.
    """
    names = ("n", "sy", "syy", "sse")
    if table:
        every = written(sums.groupBy(*keys).agg(*(F.sum(c).alias(f"_t_{c}") for c in names)), "jackknife")
        sums, tot = sums.join(F.broadcast(every), keys), {c: F.col(f"_t_{c}") for c in names}
    else:
        w = Window.partitionBy(*keys)
        tot = {c: F.sum(c).over(w) for c in names}

    def score(n, sy, syy, sse):
        return 1 - sse / F.nullif(syy - sy * sy / F.nullif(n, F.lit(0)), F.lit(0.0))

    x = sums.withColumn("pooled", score(*tot.values())).withColumn("left_out", score(*(tot[c] - F.col(c) for c in tot)))
    k = F.count("*")
    x = x.groupBy(*keys).agg(F.first("pooled").alias("pooled"), F.avg("left_out").alias("_m"), k.alias("k"), F.sum(F.col("left_out") * F.col("left_out")).alias("_q"))
    se = F.sqrt(F.greatest((F.col("k") - 1) / F.col("k") * (F.col("_q") - F.col("k") * F.col("_m") * F.col("_m")), F.lit(0.0)))
    t = t95(F.col("k") - 1)
    return x.withColumn("ci_lo", F.col("pooled") - t * se).withColumn("ci_hi", F.col("pooled") + t * se).drop("_m", "_q")


def error_concentration(df: DataFrame, keys: list[str], y: str, pred: str, fractions: tuple[float, ...] = (0.01, 0.05), rows: int = RANGE_ROWS) -> DataFrame:
    """Share of the squared error held by the worst rows (max(1, round-half-even(f * n)) of them), median error, RMSE. Rows of one error count together and errors
    are ordered in ranges, so a key may hold all rows."""
    e = F.col(y) - F.col(pred)
    x = df.withColumn("_e2", e * e).where("_e2 is not null")
    x = written(counted(x, keys, "_e2", rows), "errors")
    n = x.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = x.join(n, keys) if keys else x.join(F.broadcast(n))  # one row
    worse = F.col("_all") - F.col("_upto")  # rows of larger errors
    top = lambda f: F.greatest(F.bround(F.col("_all") * f), F.lit(1))
    held = lambda f: F.col("_e2") * F.greatest(F.least(F.col("_n"), top(f) - worse), F.lit(0))
    sse = F.sum(F.col("_e2") * F.col("_n"))
    share = [(F.sum(held(f)) / F.nullif(sse, F.lit(0.0))).alias(f"share_{round(100 * f)}") for f in fractions]
    out = ranked.groupBy(*keys).agg(*share, F.sqrt(sse / F.sum("_n")).alias("rmse"), F.sum("_n").alias("n"))
    median = percentiles_by(df.withColumn("_ae", F.abs(e)), keys, "_ae", {"med_ae": 0.5}, rows)
    return out.join(median, keys) if keys else out.join(F.broadcast(median))  # one row


def ensemble_crps(obs: DataFrame, members: DataFrame, keys: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """Exact CRPS of each observation (keys, id, y) against its ensemble (keys, x): mean|x-y| - mean|x-x'|/2.

    Prefix sums over the distinct values give both terms: the spread by rank weights, the distance by the members up to y. Values are ordered in ranges.
    """
    m = members.where("x is not null").groupBy(*keys, F.col("x").alias("v")).agg(F.count("*").alias("_n"))
    both = m.unionByName(obs.where("y is not null").groupBy(*keys, F.col("y").alias("v")).agg(F.lit(0).cast("long").alias("_n"))).groupBy(*keys, "v").agg(F.sum("_n").alias("_n"))
    both = written(running(both, keys, [F.col("v")], {"_below": F.col("_n"), "_low": F.col("v") * F.col("_n")}, rows), "ensemble")
    # places of tied members are before + 1 to before + n
    weight = F.col("v") * F.col("_n") * (2 * (F.col("_below") - F.col("_n")) + F.col("_n") + 1)
    spread = both.groupBy(*keys).agg(F.sum("_n").alias("m"), F.sum(F.col("v") * F.col("_n")).alias("sx"), F.sum(weight).alias("rx")).where("m > 0")
    x = obs.where("y is not null").withColumn("v", F.col("y")).join(both.select(*keys, "v", "_below", "_low"), [*keys, "v"]).join(spread, keys)
    y, low = F.col("y"), F.col("_low")
    distance = (y * F.col("_below") - low + (F.col("sx") - low) - y * (F.col("m") - F.col("_below"))) / F.col("m")
    gini = (F.col("rx") - (F.col("m") + 1) * F.col("sx")) / (F.col("m") * F.col("m"))
    return x.select(*keys, F.col("id").cast("long").alias("id"), "y", (distance - gini).alias("crps"))


def margins(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each score minus its control's (is_control, one per key: more than one is an error)."""
    control = scores.where("is_control").groupBy(*keys).agg(F.max(value).alias("control"), F.count("*").alias("_n"))
    control = control.withColumn("control", F.when(F.col("_n") == 1, F.col("control")).otherwise(F.raise_error(F.lit("more than one control for a key")).cast("double"))).drop("_n")
    x = scores.where("not is_control").join(control, keys, "left")
    return x.withColumn("margin", F.col(value) - F.col("control"))


def paired_verdict(scores: DataFrame, keys: list[str], value: str, baseline: str) -> DataFrame:
    """Mean paired difference to the baseline over shared folds, its t interval and a verdict; the baseline itself has neither, and ``baseline`` for a verdict."""
    b = scores.where(F.col("model") == baseline).select(*keys, "fold", F.col(value).alias("_b"))
    x = scores.where(F.col("model") != baseline).join(b, [*keys, "fold"]).withColumn("diff", F.col(value) - F.col("_b"))
    x = t_interval(x, [*keys, "model"], "diff")
    separable = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    x = x.withColumn("separable", separable).withColumn("verdict", F.when(F.col("mean") >= 0, "passed").otherwise("lossy"))
    itself = b.select(*keys).distinct().withColumns({"model": F.lit(baseline), "separable": F.lit(False), "verdict": F.lit("baseline")})
    return x.unionByName(itself, allowMissingColumns=True)


def missing_cells(actual: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Cells of the full grid of (small) dimension tables that ``actual`` lacks."""
    grid = None
    for d in dimensions.values():
        grid = d if grid is None else grid.join(F.broadcast(d))
    return grid.join(actual.select(*dimensions).distinct(), list(dimensions), "left_anti")


def rank_stability(scores: DataFrame, modes: str, item: str, value: str) -> DataFrame:
    """Order of items by score in each mode, and whether all modes agree."""
    order = scores.groupBy(modes).agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("s"), F.col(item).alias("i")))).alias("x"))
    order = order.select(modes, F.array_join(F.col("x.i").cast("array<string>"), ">").alias("ranking"))
    return order.withColumn("stable", F.min("ranking").over(Window.partitionBy(F.lit(1))) == F.max("ranking").over(Window.partitionBy(F.lit(1))))


def detectable_effect(scores: DataFrame, keys: list[str], value: str, aim: float) -> DataFrame:
    """Least detectable effect at 5 % and 80 % power, and folds needed for ``aim``."""
    x = scores.groupBy(*keys).agg(F.stddev_samp(value).alias("std"), F.count("*").alias("k"))
    return x.withColumn("mde", POWER * F.col("std") / F.sqrt("k")).withColumn("folds_needed", F.ceil(F.pow(POWER * F.col("std") / aim, 2)))
