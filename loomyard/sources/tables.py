"""Parquet table access with column pruning and one rule for timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read <sf_dir>/<name>.parquet (a file or a folder of parts), only the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """Schema-only read; no row group is touched."""
    return spark.read.parquet(path).schema


def micros(c) -> F.Column:
    """Epoch microseconds of a timestamp (zoneless ones mean UTC); the session zone must be UTC."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
