"""Duplicates, conflicts, null profiles, table differences, a cleaning log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fingerprint(columns: Sequence[str]) -> Column:
    """One value per combination, nulls included (equal nulls are equal)."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def duplicate_kinds(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, copies, kind) of keys on more than one row: 'exact' if all copies agree, else 'conflict'."""
    g = df.withColumn("__f", _fingerprint(values)).groupBy(*keys).agg(F.count("*").alias("copies"), F.min("__f").alias("a"), F.max("__f").alias("z"))
    return g.where("copies > 1").select(*keys, "copies", F.when(F.col("a") == F.col("z"), "exact").otherwise("conflict").alias("kind"))


def resolve_duplicates(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: exact copies collapse, keys with differing copies are left out."""
    f = F.struct(*[F.col(c) for c in values])
    g = df.withColumn("__f", _fingerprint(values)).groupBy(*keys).agg(F.min("__f").alias("a"), F.max("__f").alias("z"), F.first(f).alias("v"))
    return g.where("a = z").select(*keys, "v.*")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, n_rows), one pass."""
    columns = list(columns or df.columns)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"c{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null"), F.col("n").alias("n_rows")) for i, c in enumerate(columns)])))


def table_diff(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, agree, differ, total) over the keys of both tables; an absent row agrees with nothing."""
    l = a.select(F.col(key).alias("k"), F.lit(1).alias("here"), *[F.col(c).alias(f"l_{c}") for c in columns])  # noqa: E741
    r = b.select(F.col(key).alias("k"), F.lit(1).alias("there"), *[F.col(c).alias(f"r_{c}") for c in columns])
    j = l.join(r, "k", "full_outer")
    both = F.col("here").isNotNull() & F.col("there").isNotNull()
    row = j.agg(F.count("*").alias("n"), *[F.count(F.when(both & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), 1)).alias(f"a_{c}") for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("agree"), (F.col("n") - F.col(f"a_{c}")).alias("differ"), F.col("n").alias("total")) for c in columns])))


class CleaningLog:
    """Steps with the number of rows they affected, as lazily evaluated rows (position, step, affected)."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.steps = df, []

    def null_out(self, step: str, column: str, bad: Column) -> CleaningLog:
        self._note(step, self.df.where(bad))
        self.df = self.df.withColumn(column, F.when(~F.coalesce(bad, F.lit(False)), F.col(column)))
        return self

    def drop(self, step: str, bad: Column) -> CleaningLog:
        self._note(step, self.df.where(bad))
        self.df = self.df.where(~F.coalesce(bad, F.lit(False)))
        return self

    def keep_known(self, step: str, other: DataFrame, on: str) -> CleaningLog:
        keys = other.select(on).distinct()
        self._note(step, self.df.join(keys, on, "left_anti"))
        self.df = self.df.join(keys, on, "left_semi")
        return self

    def _note(self, step: str, rows: DataFrame) -> None:
        self.steps.append(rows.agg(F.count("*").alias("affected")).select(F.lit(len(self.steps)).alias("position"), F.lit(step).alias("step"), "affected"))

    def log(self) -> DataFrame:
        out = self.steps[0]
        for s in self.steps[1:]:
            out = out.unionByName(s)
        return out
