"""Text sources and the sinks: manifests, hourly series, atomic tables with provenance, deterministic CSV and JSON."""

from __future__ import annotations

import hashlib
import io
import json
import math
import csv as _csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all text, nothing inferred: 'NA' stays 'NA', an empty field is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def load_manifest(spark: SparkSession, path: str, columns: list[str], key: str, token: str, *, limit: int | None = None) -> DataFrame:
    """A manifest that is not empty, has unique keys and tokens of 16 hex digits; the first `limit` rows by key."""
    df = read_text_table(spark, path, columns)
    ok = F.col(token).rlike("^[0-9a-f]{16}$")
    n, distinct, bad = df.agg(F.count("*"), F.countDistinct(key), F.count(F.when(F.coalesce(~ok, F.lit(True)), 1))).first()
    if not n or n != distinct or bad:
        raise ValueError(f"manifest: {n} rows, {distinct} keys, {bad} bad tokens")
    return df.orderBy(key).limit(limit) if limit else df


def read_hourly(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Cached JSON of parallel arrays under `hourly` to one row per hour: hour_us and the fields."""
    struct = ", ".join(f"{f}: array<double>" for f in fields)
    raw = spark.read.schema(f"hourly struct<time: array<string>, {struct}>").option("multiLine", True).json(path)
    rows = raw.select(F.inline(F.arrays_zip("hourly.time", *[f"hourly.{f}" for f in fields])))
    return rows.select(F.unix_micros(F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm")).alias("hour_us"), *fields)


def write_table(df: DataFrame, path: str, provenance: dict | None = None, *, partition_by: list[str] | None = None) -> None:
    """Parquet, refused if the path exists; the commit protocol makes it all or nothing. Provenance goes last, beside it."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if provenance is not None:
        df.sparkSession.createDataFrame([(to_json(provenance),)], "value string").coalesce(1).write.mode("errorifexists").text(path.rstrip("/") + ".provenance")


def write_checked(df: DataFrame, path: str) -> None:
    """write_table, then read back and compared with multiplicity, both ways."""
    write_table(df, path)
    back = df.sparkSession.read.parquet(path)
    if not df.exceptAll(back).isEmpty() or not back.exceptAll(df).isEmpty():
        raise OSError(f"{path}: read back differently")


def update_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has; others stay: resumable shards."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def csv_bytes(df: DataFrame, order: list[str], *, most_rows: int = 1_000_000) -> tuple[bytes, str]:
    """A small result as deterministic CSV (UTF-8, LF) with its SHA-256; more than most_rows are refused."""
    rows = df.orderBy(*order).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for one CSV file; write a table")
    out = io.StringIO()
    w = _csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(["" if x is None else x for x in r] for r in rows)
    data = out.getvalue().encode()
    return data, hashlib.sha256(data).hexdigest()


def to_json(value) -> str:
    """Sorted keys; NaN and infinities become null."""

    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), sort_keys=True, ensure_ascii=False)
