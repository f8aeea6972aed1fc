"""Contracts between vector tables and their keys: joins, agreement, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contract_violations(left: DataFrame, right: DataFrame, keys: list[str], near: dict[str, float]) -> DataFrame:
    """(keys, problem): rows that one side lacks, and rows whose columns differ by more than allowed."""
    a = left.select(*keys, *(F.col(c).alias(f"{c}_a") for c in near), F.lit(True).alias("_a"))
    b = right.select(*keys, *(F.col(c).alias(f"{c}_b") for c in near), F.lit(True).alias("_b"))
    x = a.join(b, keys, "full_outer")
    problem = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left")
    for c, tol in near.items():
        problem = problem.when(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) > tol, f"{c}_differs")
    return x.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def agreement(left: DataFrame, right: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Shared rows and the largest difference of any component."""
    x = left.select(*keys, F.col(vec).alias("_a")).join(right.select(*keys, F.col(vec).alias("_b")), keys)
    worst = F.array_max(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)))
    return x.agg(F.count("*").alias("shared"), F.max(worst).alias("max_abs_diff"))


def audit(catalog: DataFrame, version: int) -> DataFrame:
    """(name, status) for catalog rows (name, cube, encoder, schema_version, has_fields, known, readable): one status each.

    Of several current sources of one (cube, encoder), the canonical name stays current and the rest are duplicates.
    """
    status = (
        F.when(~F.col("readable"), "unreadable").when(~F.col("known"), "foreign").when(F.col("schema_version").isNull() | (F.col("schema_version") != version), "unstamped").when(~F.col("has_fields"), "incomplete").otherwise("current")
    )
    x = catalog.withColumn("status", status).withColumn("canonical", F.col("name") == F.concat_ws("__", F.col("cube").cast("string"), "encoder"))
    w = Window.partitionBy("cube", "encoder", "status").orderBy(F.col("canonical").desc(), "name")
    return x.withColumn("_r", F.row_number().over(w)).select("name", F.when((F.col("status") == "current") & (F.col("_r") > 1), "duplicate").otherwise(F.col("status")).alias("status"))


def not_cached(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs still to be made."""
    return wanted.join(cached.select(*keys), keys, "left_anti")
