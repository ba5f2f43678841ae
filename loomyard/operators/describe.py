"""Descriptions of tables: counts, extents, distributions, crosstabs, decompositions, empirical distribution functions.

All are one aggregation with map-side combine, or say otherwise. Empty tables give no group, or one row of nulls and zero
counts where there is no grouping. Nulls of a value take no part in its figures; a null group is a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions


def value_counts(df: DataFrame, columns: Sequence[str], null: str = "null") -> DataFrame:
    """(column, value, n): how often each value stands in each column, as text, nulls under `null`. One pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)).alias("value")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def extents(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high, n): least and greatest value, as whole numbers, and how many are not null."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(c).cast("long").alias(f"a{i}"), F.max(c).cast("long").alias(f"z{i}"), F.count(c).alias(f"n{i}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("low"), F.col(f"z{i}").alias("high"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])))


def percentiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[float], digits: int = 6) -> DataFrame:
    """count, mean, sample deviation, least, exact percentiles (linear) and greatest value per group."""
    x = F.col(value)
    p = [F.round(F.percentile(x, F.lit(q)), digits).alias(f"p{round(q * 100):02d}") for q in at]
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(F.stddev_samp(x), digits).alias("std"), F.round(F.min(x), digits).alias("low"), *p, F.round(F.max(x), digits).alias("high"))


def distribution(df: DataFrame, group: Sequence[str], value: str, shares: Mapping[str, Column], digits: int = 6) -> DataFrame:
    """mean, median, sample deviation and the share of non-null values for which each condition holds, per group."""
    x = F.col(value)
    of = [F.round(F.avg(F.when(x.isNotNull(), c.cast("double"))), digits).alias(n) for n, c in shares.items()]
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(F.median(x), digits).alias("median"), F.round(F.stddev_samp(x), digits).alias("std"), *of)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per value of `row`, one count per given value of `column`, zero filled; the values are given, so no job is run."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def decompose(df: DataFrame, value: str, parts: Mapping[str, Column], rest: str = "rest", digits: int = 6) -> DataFrame:
    """(part, n, total, share): a total split into disjoint parts, the first that holds taking the row, what is left in `rest`."""
    part = F.lit(None)
    for name, c in parts.items():
        part = F.coalesce(part, F.when(F.coalesce(c, F.lit(False)), name))
    sums = df.groupBy(F.coalesce(part, F.lit(rest)).alias("part")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("part", "n", F.round("total", digits).alias("total"), F.round(F.try_divide(F.col("total"), F.col("whole")), digits).alias("share"))  # one row


def variance_within(df: DataFrame, group: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """(groups, n, within, overall): population variance within groups of at least `least` values, averaged over the groups,
    and that of all their values."""
    per = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("c"), F.var_pop(value).alias("v"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).where(F.col("c") >= least)
    n, mean = F.sum("c"), F.sum("s") / F.sum("c")
    return per.agg(F.count("*").alias("n_groups"), F.coalesce(n, F.lit(0)).alias("n"), F.round(F.avg("v"), 6).alias("within"), F.round(F.sum("q") / n - mean * mean, 6).alias("overall"))


def shares_over(df: DataFrame, group: str, condition: Column, least: float) -> DataFrame:
    """(group, n, hits, share, ok): the share of rows for which the condition holds and whether it reaches `least`."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count(F.when(condition, 1)).alias("hits"))
    share = F.col("hits") / F.col("n")
    return g.select(group, "n", "hits", F.round(share, 6).alias("share"), (share >= least).alias("ok"))


def first_per(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the row that comes first in the order (nulls last), per group; an aggregate, so no group is sorted."""
    key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    return df.groupBy(*group).agg(F.min_by(F.struct(*values), key).alias("__v")).select(*group, "__v.*")


def cumulative_share(df: DataFrame, group: list[str], value: str, tie: str, name: str = "cdf") -> DataFrame:
    """The empirical distribution function: position of the value in its group over the group's size, ties in the order of `tie`."""
    rows = df.where(F.col(value).isNotNull())
    p = positions(rows, group, [F.col(value), F.col(tie)], name="__p")
    return p.join(rows.groupBy(*group).agg(F.count("*").alias("__n")), group).withColumn(name, F.col("__p") / F.col("__n")).drop("__p", "__n")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order: every task keeps n rows, no full sort."""
    return df.orderBy(*order).limit(n)


def changed(keys: Sequence[str], before: Mapping[str, str], after: Mapping[str, str], least: float = 0.01) -> Column:
    """Text of the components that differ by more than `least`, the largest change first, then by name: "name -0.2500; ..."."""
    diffs = F.array(*[F.struct((-F.abs(F.col(after[k]) - F.col(before[k]))).alias("size"), F.lit(k).alias("name"), (F.col(after[k]) - F.col(before[k])).alias("diff")) for k in keys])
    kept = F.array_sort(F.filter(diffs, lambda x: x["size"] < -least))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(" ", x["name"], F.format_string("%+.4f", x["diff"]))), "; ")
