"""Masks, the masked index, clear fractions and frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest denominator of the index.
LEAST_DENOMINATOR = 1e-12


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_codes(c: str, clear: tuple) -> Column:
    """Membership; null codes are not valid."""
    return F.coalesce(F.col(c).isin(*clear), F.lit(False))


def clear_sky(code: str, clear: tuple, scene: str | None = None, scenes: tuple = ()) -> Column:
    """Clear by code and, unless left out, by scene class."""
    return valid_codes(code, clear) & valid_codes(scene, scenes) if scene else valid_codes(code, clear)


def fallback_mask(sources: list[tuple[str, tuple]]) -> tuple[Column, Column]:
    """The first source that has a value decides; returns the mask and the name of the source used."""
    valid, source = F.lit(False), F.lit("none")
    for name, clear in reversed(sources):
        valid = F.when(F.col(name).isNotNull(), F.col(name).isin(*clear)).otherwise(valid)
        source = F.when(F.col(name).isNotNull(), F.lit(name)).otherwise(source)
    return valid, source


def ndvi(nir: str, red: str, valid: str) -> Column:
    """(nir - red) / (nir + red) in double, stored as float; null unless valid, finite and well defined."""
    a, b = F.col(nir).cast("double"), F.col(red).cast("double")
    return F.when(F.col(valid) & finite(a) & finite(b) & (F.abs(a + b) > LEAST_DENOMINATOR), (a - b) / (a + b)).cast("float")


def finite_valid(valid: str, bands: list[str]) -> Column:
    out = F.col(valid)
    for b in bands:
        out = out & finite(b)
    return F.coalesce(out, F.lit(False))


def drop_empty_steps(px: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Steps without any finite value in any band go."""
    any_finite = finite(bands[0])
    for b in bands[1:]:
        any_finite = any_finite | finite(b)
    alive = px.groupBy(*keys).agg(F.max(any_finite).alias("_alive")).where("_alive").select(*keys)
    return px.join(alive, keys, "left_semi")


def clear_fraction(px: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg(F.col("valid").cast("double")).alias("clear_frac"), F.count("*").alias("n_pixels"), *more)


def select_clear(df: DataFrame, min_clear: float = 0.5) -> DataFrame:
    """Strictly above the limit; the limit may only be tightened."""
    if not 0.5 <= min_clear < 1.0:
        raise ValueError(f"min_clear may only be tightened from 0.5: {min_clear}")
    return df.where(F.col("clear_frac") > min_clear)


def seven_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and five exact percentiles of one band."""
    p = F.expr(f"percentile({value}, array(0.1, 0.25, 0.5, 0.75, 0.9))")
    x = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("_p"))
    return x.select(*keys, "mean", "std", *(F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))))


def wide_statistics(df: DataFrame, keys: list[str], bands: dict[str, str]) -> DataFrame:
    """The seven statistics of each band (name: column) as columns ``<name>_mean``, ``<name>_std``, ``<name>_p10`` ..., from one aggregation."""
    aggs = [a for n, c in bands.items() for a in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.expr(f"percentile({c}, array(0.1, 0.25, 0.5, 0.75, 0.9))").alias(f"_{n}"))]
    x = df.groupBy(*keys).agg(*aggs)
    wide = [F.col(f"{n}_{s}") if s in ("mean", "std") else F.get(f"_{n}", F.lit(i - 2)).alias(f"{n}_{s}") for n in bands for i, s in enumerate(("mean", "std", "p10", "p25", "p50", "p75", "p90"))]
    return x.select(*keys, *wide)


def prevalence(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Share of valid values above a plausible limit, with both maxima."""
    ok = F.col("valid")
    return df.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.count_if(ok & (F.col(value) > limit)), F.count_if(ok)), F.lit(0.0)).alias("share"), F.max(F.when(ok, F.col(value))).alias("valid_max"), F.max(value).alias("global_max")
    )


def dominant(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Most frequent code (lowest of a tie) and its share."""
    n = df.groupBy(*keys, code).count()
    top = n.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("m"), F.col(code).alias("dominant"))).alias("x"), F.sum("count").alias("total"))
    return top.select(*keys, F.col("x.dominant").alias("dominant"), (-F.col("x.m") / F.col("total")).alias("purity"))


def column_sets(columns: list[str], groups: dict[str, tuple[str, ...]]) -> dict[str, list[int]]:
    """Places of the columns of each group of prefixes; a column in no group or in two, and an empty group, are errors."""
    sets = {g: [i for i, c in enumerate(columns) if c.startswith(prefixes)] for g, prefixes in groups.items()}
    if sorted(i for places in sets.values() for i in places) != list(range(len(columns))):
        raise ValueError(f"{groups} do not hold each of {columns} once")
    if not all(sets.values()):
        raise ValueError(f"empty: {[g for g, places in sets.items() if not places]}")
    return sets


def sliced(vec: str, places: list[int]) -> Column:
    """The components of a vector at ``places``."""
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(vec, i))
