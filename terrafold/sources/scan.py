"""Catalogue scans: files under a folder at any depth, their ids from their paths, and columns that go by several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .minicube import first_present


class NoFilesError(FileNotFoundError):
    """Nothing matches under the folder."""


def files(spark: SparkSession, root: str, pattern: str = "*.parquet", limit: int | None = None) -> DataFrame:
    """(path, length) under ``root`` at any depth whose names match, in order of path, the first ``limit`` of them; none is an error. Contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length").orderBy("path")
    if not x.head(1):
        raise NoFilesError(f"no {pattern} under {root}")
    return x.limit(limit) if limit else x


def id_of(path: str | Column, pattern: str) -> Column:
    """What the first group of ``pattern`` matches in a path; a path without it is an error."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no id in "), path)))


def resolved(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with each variable of ``names`` from the first of its candidates that a row has; a variable without any candidate among the columns is an error."""
    out = {}
    for variable, candidates in names.items():
        first_present(df, candidates)
        out[variable] = F.coalesce(*(F.col(f"`{c}`") for c in candidates if c in df.columns))
    used = {c for cs in names.values() for c in cs}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in used), *(v.alias(n) for n, v in out.items()))


def cubes(spark: SparkSession, root: str, names: dict[str, tuple[str, ...]], id_pattern: str, pattern: str = "*.parquet") -> DataFrame:
    """All files under ``root`` as one table: ``id`` from the path, and the variables of ``names`` whatever each file calls them.

    Files of several schemas are read as one, missing columns null, so each variable comes from the first of its candidates that the row's file holds a value in.
    """
    files(spark, root, pattern, 1)
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mergeSchema", "true").parquet(root)
    return resolved(x.select("*", id_of(F.col("_metadata.file_path"), id_pattern).alias("id")), names)
