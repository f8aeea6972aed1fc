"""Result tables: CSV files with an explicit schema, checked after reading back, and comparison of two tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NULL = "NA"


def write_csv(df: DataFrame, path: str) -> None:
    """Header, nulls as ``NA``, text quoted; an existing table is replaced."""
    df.write.mode("overwrite").csv(path, header=True, nullValue=NULL, quoteAll=True)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Values that do not fit the schema are errors, not nulls."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=NULL, mode="FAILFAST", enforceSchema=False)


def invariant_violations(df: DataFrame, keys: list[str], control: str) -> DataFrame:
    """(keys, problem): keys without exactly one control row. Empty for a sound table."""
    n = F.count_if(F.col(control))
    x = df.groupBy(*keys).agg(n.alias("_n")).where("_n <> 1")
    return x.select(*keys, F.when(F.col("_n") == 0, "no control").otherwise("more than one control").alias("problem"))


def compare(new: DataFrame, old: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """Each cell of ``new`` with its old value and the change; both null where the old table or cell is missing."""
    x = new.select(*keys, F.col(value).alias("new"))
    if old is None:
        return x.withColumn("old", F.lit(None).cast("double")).withColumn("change", F.lit(None).cast("double"))
    x = x.join(old.select(*keys, F.col(value).alias("old")), keys, "left")
    return x.withColumn("change", F.col("new") - F.col("old"))


def earlier(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
