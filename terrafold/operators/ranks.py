"""Places in a sorted order and running sums, in ranges: neither a hot key nor a whole table is ordered in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders.
RANGE_ROWS = 65_536
#: Rows that one task groups or joins.
GROUP_ROWS = 262_144
#: Spark's switch that removes an execution's shuffle files at its end; else they lie until the driver's next collection of garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names: cuts lineage, survives lost executors; the shuffle files behind it go as soon as it stands."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], n: int | None = None, rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` (``n`` rows; counted if not given) hashed by ``keys`` into partitions whose number grows with its rows, for groupings and joins by these keys or by more.

    Left to itself a shuffle has a fixed number of partitions, merged up to a size in bytes, so the hash tables and sorts of one task would grow with the table.
    """
    parts = -(-(df.count() if n is None else n) // rows)
    if parts <= 8:  # few rows at any number of partitions
        return df.repartition(*keys)
    # not below the default, or a join would shuffle once more
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], rows: int = RANGE_ROWS, table: bool = False) -> DataFrame:
    """``df`` with running sums inside each key, in ``order``, the row itself included; names are those of ``sums``.

    Rows are dealt into ranges of (keys, order) and written, so that ranges stay as they are; a sum is that of the ranges before plus that inside
    the row's own. Rows that tie in ``order`` lie in one range, in any order. ``table``: ``df`` only reads a table already, so it is not written before it is sorted.
    """
    x = df.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    x = x if table else written(x, "ranks-rows")
    parts = max(1, -(-x.count() // rows))
    x = written(x.repartitionByRange(parts, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranks")
    heads = x.groupBy(*keys, "_p").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_p").alias("_p2"), *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    inner = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(inner), F.lit(0)) for i in range(len(sums))})
    same = F.col("_p") == F.col("_p2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.join(heads, same)
    return x.select(*df.columns, *((F.col(f"_b{i}") + F.col(f"_i{i}")).alias(n) for i, n in enumerate(sums)))


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str, rows: int = RANGE_ROWS, table: bool = False) -> DataFrame:
    """``df`` with ``name``: the row's place inside its key, from 1; ``order`` should leave no ties. ``table`` as in ``running``."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, rows, table)


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation, as scalars: only rows at the wanted places leave the executors."""
    x = row_numbers(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), [], [F.col("v")], "_n")
    x = written(x, "ranks-sorted")
    n = x.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(p) + 1 for p in places} | {min(int(p) + 2, n) for p in places})
    found = {r["_n"]: r["v"] for r in x.where(F.col("_n").isin(wanted)).collect()}  # two rows a percentile
    return [found[int(p) + 1] + (found[min(int(p) + 2, n)] - found[int(p) + 1]) * (p - int(p)) for p in places]


def counted(df: DataFrame, keys: list[str], value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, value, _n, _upto): the distinct values of each key, how many rows have each, and how many have it or a smaller one.

    Rows that tie become one row before anything is sorted, so neither a hot key nor a hot value is held by one task.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return running(x, keys, [F.col(value)], {"_upto": F.col("_n")}, rows)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, value, name): the mean place, from 1, of the rows that tie at each value."""
    return counted(df, keys, value, rows).select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def percentiles_by(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, names of ``shares``): exact percentiles of each key with linear interpolation, without a buffer of its values."""
    x = written(counted(df.withColumn(value, F.col(value).cast("double")), keys, value, rows), "ranks-counted")
    # columns under names of their own, so that keys may be null
    n = x.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.sum("_n").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.join(n, same) if keys else x.join(F.broadcast(n))  # one row
    at = {s: F.col("_all") * F.lit(share) - F.lit(share) for s, share in shares.items()}  # from 0
    holds = lambda place: (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))
    found = [F.max(F.when(holds(F.floor(a)), F.col(value))).alias(f"_lo_{s}") for s, a in at.items()] + [F.max(F.when(holds(F.least(F.floor(a) + 1, F.col("_all") - 1)), F.col(value))).alias(f"_hi_{s}") for s, a in at.items()]
    y = x.groupBy(*keys).agg(F.max("_all").alias("_all"), *found)
    return y.select(*keys, *((F.col(f"_lo_{s}") + (F.col(f"_hi_{s}") - F.col(f"_lo_{s}")) * (a - F.floor(a))).alias(s) for s, a in at.items()))
