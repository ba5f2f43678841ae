"""Declarative checks. Each gives one row (check, status, violations, detail); one that raises becomes FAIL, alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, violations: Column, detail: Column | None = None) -> DataFrame:
    v = F.coalesce(violations.cast("long"), F.lit(0).cast("long"))
    return df.agg(v.alias("violations"), (detail if detail is not None else F.lit("")).alias("detail")).select(F.lit(name).alias("check"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations", "detail")


def unique(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    dup = df.groupBy(*keys).count().where("count > 1")
    return _row(dup, name, F.count("*"))


def not_null(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return _row(df, name, F.count(F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]), 1)))


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true (null counts as a violation)."""
    return _row(df, name, F.count(F.when(~F.coalesce(condition, F.lit(False)), 1)))


def count_rows(df: DataFrame, name: str) -> DataFrame:
    """Every row is a violation."""
    return _row(df, name, F.count("*"))


def in_range(df: DataFrame, name: str, column: str, low: float, high: float) -> DataFrame:
    """Non-null values outside the closed range; NaN is outside."""
    return _row(df, name, F.count(F.when(~F.col(column).between(low, high) | F.isnan(F.col(column).cast("double")), 1)))


def in_domain(df: DataFrame, name: str, column: str, values: Sequence[str]) -> DataFrame:
    return _row(df, name, F.count(F.when(F.col(column).isNotNull() & ~F.col(column).isin(*values), 1)))


def covered(df: DataFrame, name: str, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of df that are absent from the other table."""
    return _row(df.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti"), name, F.count("*"))


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows in one table and not in the other, with multiplicity, both ways."""
    return _row(a.exceptAll(b).unionByName(b.exceptAll(a)), name, F.count("*"))


def columns_match(df: DataFrame, name: str, expected: Sequence[str]) -> DataFrame:
    """Schema only, no scan: missing and undeclared columns."""
    off = sorted(set(expected) ^ set(df.columns))
    return df.sparkSession.createDataFrame([(name, "FAIL" if off else "PASS", len(off), "|".join(off))], "check string, status string, violations long, detail string")


def warn_only(df: DataFrame) -> DataFrame:
    """A check whose violations are a WARN, not a FAIL."""
    return df.withColumn("status", F.when(F.col("status") == "FAIL", "WARN").otherwise(F.col("status")))


def report(checks: Sequence[tuple[str, Callable[[], DataFrame]]], spark) -> DataFrame:
    """All checks as one table, in their order. A check that can't be built, or fails while it runs, is a FAIL with the
    error as its detail; it never takes the others down. Each check is run here, on its own: its row is what reaches the driver."""
    out = []
    for i, (name, make) in enumerate(checks):
        try:
            out += [(i, r["check"], r["status"], r["violations"], r["detail"]) for r in make().select("check", "status", "violations", "detail").limit(2).collect()]
        except Exception as e:  # noqa: BLE001
            out.append((i, name, "FAIL", 1, (str(e).splitlines() or [""])[0][:200]))
    return spark.createDataFrame(out, "position int, check string, status string, violations long, detail string")
