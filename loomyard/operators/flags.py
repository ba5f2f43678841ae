"""Rules as flag columns (nothing is dropped) and funnels over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(df: DataFrame, flags: Sequence[str], name: str) -> DataFrame:
    """The conjunction of flags; a null flag counts as false."""
    return df.withColumn(name, reduce(lambda a, b: a & b, [safe(f) for f in flags]))


def safe(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def keep(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose flag is true, one row with n_kept and n_excluded); a null flag counts as false."""
    ok = safe(flag)
    return df.where(ok), df.agg(F.count(F.when(ok, 1)).alias("n_kept"), F.count(F.when(~ok, 1)).alias("n_excluded"))


def keys_of_any(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """The distinct keys of all rows for which any of the flags holds; null keys are left out."""
    return df.where(reduce(lambda a, b: a | b, [safe(f) for f in flags]) & F.col(key).isNotNull()).select(key).distinct()


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, common): distinct non-null keys of two tables, in one shuffle."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("s"))).where("k is not null")
    sides = both.groupBy("k").agg(F.bit_or("s").alias("s"))
    return sides.agg(*[F.count(F.when(F.col("s") == i, 1)).alias(n) for i, n in ((1, "only_left"), (2, "only_right"), (3, "common"))])


def funnel(df: DataFrame, rules: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """(step, rule, n_rows, n_<key>...): what is left after each rule in turn, in one pass. Step 0 is all rows."""
    steps, held = [("all", F.lit(True))], F.lit(True)
    for r in rules:
        held = held & safe(r)
        steps.append((r, held))
    aggs = []
    for i, (_, c) in enumerate(steps):
        aggs.append(F.count(F.when(c, 1)).alias(f"r{i}"))
        aggs += [F.countDistinct(F.when(c, F.col(k))).alias(f"d{i}_{k}") for k in distinct]
    row = df.agg(*aggs)
    each = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_rows"), *[F.col(f"d{i}_{k}").alias(f"n_{k}") for k in distinct]) for i, (n, _) in enumerate(steps)]
    return row.select(F.inline(F.array(*each)))


def typed(c: Column, kind: str) -> Column:
    """Text to int, double or boolean: blank and invalid give null; a double that isn't finite is invalid."""
    t = F.nullif(F.btrim(c), F.lit(""))
    if kind == "boolean":
        low = F.lower(t)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    x = t.try_cast(kind)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) if kind == "double" else x


def invalid(c: Column, kind: str) -> Column:
    """Is there text that isn't a value of the kind?"""
    return (F.btrim(c) != "") & typed(c, kind).isNull()


def within(c: Column, low: float, high: float) -> Column:
    """The value if it lies in the closed range, else null; NaN is outside."""
    return F.when(c.between(low, high) & ~F.isnan(c), c)
