"""Versioned stores of embeddings and masks.

Embeddings lie in folders by schema version and encoder, with a catalogue of what was written under which version. Reading refuses what the present
version does not describe, before a row is read. Masks lie in buckets of frames, sorted, so joins of frames with their pixels need no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality

#: The present schema of embeddings: what each row must have, and what it may have besides.
VERSION = 3
REQUIRED = {"cube": "string", "encoder": "string", "acq_idx": "int", "ts": "date", "vec": "array<float>", "clear_frac": "double", "window_span_days": "double"}
OPTIONAL = {"grid_clear_frac": "array<double>"}


class StoreError(ValueError):
    """A store that this version must not read or write."""


class NoStoreError(StoreError):
    """Nothing was written there."""


class SchemaVersionError(StoreError):
    """Rows of another version, of several, or without one."""


class MissingFieldError(StoreError):
    """Rows without a field that the version requires."""


class InvariantError(StoreError):
    """Rows that break what the version promises."""


def write_embeddings(df: DataFrame, path: str, size: int, version: int = VERSION) -> None:
    """Append ``df`` to the store at ``path``; rows are checked first. ``size`` is the length of a vector."""
    lacking = quality.missing_columns(df, list(REQUIRED))
    if lacking:
        raise MissingFieldError(f"no {', '.join(lacking)}")
    kinds = REQUIRED | {c: t for c, t in OPTIONAL.items() if c in df.columns}
    x = df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    quality.require(quality.embedding_violations(x, size), InvariantError)
    append(x, path, version)


def append(df: DataFrame, path: str, version: int | None) -> None:
    """Rows and their catalogue entry, without a look at either."""
    fields = F.array(*(F.lit(c) for c in df.columns))
    x = df.withColumn("schema_version", F.lit(version).cast("int"))
    x.write.mode("append").partitionBy("schema_version", "encoder").parquet(f"{path}/rows")
    entry = x.groupBy("schema_version", "encoder").agg(F.count("*").alias("n"), F.countDistinct("cube").alias("cubes")).withColumn("fields", fields)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/catalogue")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(schema_version, encoder, n, cubes, fields) of each time something was written."""
    try:
        return spark.read.parquet(f"{path}/catalogue")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise NoStoreError(path) from e


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all versions, for audits."""
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/rows")


def read_embeddings(spark: SparkSession, path: str, size: int, encoders: list[str] | None = None, version: int = VERSION) -> DataFrame:
    """The rows of the present version. Old, mixed or missing versions, missing fields and broken rows are errors."""
    held = catalogue(spark, path)
    if encoders is not None:
        held = held.where(F.col("encoder").isin(encoders))
    found = held.groupBy("schema_version").agg(F.array_distinct(F.flatten(F.collect_set("fields"))).alias("any"), F.collect_set("fields").alias("fields")).collect()  # a row a version
    versions = [r["schema_version"] for r in found]
    if not versions:
        raise NoStoreError(f"{path}: none of {encoders}")
    if versions != [version]:
        raise SchemaVersionError(f"{path} holds versions {versions}; this reads {version} alone")
    for fields in found[0]["fields"]:
        lacking = [c for c in REQUIRED if c not in fields]
        if lacking:
            raise MissingFieldError(f"{path}: no {', '.join(lacking)}")
    x = rows(spark, path).where(F.col("schema_version") == version)
    if encoders is not None:
        x = x.where(F.col("encoder").isin(encoders))
    quality.require(quality.embedding_violations(x, size), InvariantError)
    return x.drop("schema_version")


def audit_rows(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(name, cube, encoder, schema_version, has_fields, known, readable) of each cube and encoder of the store, from its files: what ``vectors.audit`` judges.

    ``known`` (cube) lists the cubes that belong there."""
    x = rows(spark, path)
    for c, t in REQUIRED.items():
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast(t))
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    x = x.groupBy("cube", "encoder", "schema_version").agg(F.min(whole).alias("has_fields"))
    x = x.join(known.select("cube", F.lit(True).alias("known")).distinct(), "cube", "left")
    name = F.concat_ws("__", "cube", "encoder", F.col("schema_version").cast("string"))
    return x.select(name.alias("name"), "cube", "encoder", "schema_version", "has_fields", F.coalesce("known", F.lit(False)).alias("known"), F.lit(True).alias("readable"))


# --- masks ----------------------------------------------------------------------------------------

MASKS = "frame_key bigint, cell int, valid boolean"
FRAMES = "frame_key bigint, cube bigint, acq_idx int, ts date"


def _bucketed(df: DataFrame, schema: str, order: list[str], path: str, buckets: int) -> None:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split() for c in schema.split(", "))
    table = f"t_{uuid.uuid4().hex}"
    x = df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in names)).repartition(buckets, "frame_key")  # a file a bucket
    x.write.format("parquet").bucketBy(buckets, "frame_key").sortBy(*order).option("path", path).saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # the files stay


def write_masks(frames: DataFrame, masks: DataFrame, path: str, buckets: int) -> None:
    """Frames (frame_key, cube, acq_idx, ts) and their pixels (frame_key, cell, valid), both in ``buckets`` buckets of frame_key, sorted."""
    both = masks.select("frame_key", "cell", "valid").join(frames.select("frame_key"), "frame_key", "left_semi")
    _bucketed(frames, FRAMES, ["frame_key"], f"{path}/frames", buckets)
    _bucketed(both, MASKS, ["frame_key", "cell"], f"{path}/masks", buckets)
    frames.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def read_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, masks) of a store; joined on frame_key, they meet bucket by bucket."""
    try:
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise NoStoreError(path) from e
    out = []
    for name, schema, order in (("frames", FRAMES, "frame_key"), ("masks", MASKS, "frame_key, cell")):
        table = f"t_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (frame_key) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        out.append(spark.table(table))
    return out[0], out[1]
