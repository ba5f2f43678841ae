"""Ranks within groups of any size: no task ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked_by_hash(df: DataFrame, group: list[str], key_hex: str, ties: list[str], *, digits: int = 3, name: str = "rank") -> DataFrame:
    """Adds `name`: the position from 1 of each row in its group by (key_hex, *ties), all ascending.

    key_hex is a lower-case hex text, evenly spread as a hash is. Its first `digits` digits cut each group into 16**digits
    buckets: bucket counts (pre-aggregated) are summed up per group, a bucket's rows are numbered on their own, and the
    two are added. Group columns may be null; nulls form a group.
    """
    b = df.withColumn("__bucket", F.substring(key_hex, 1, digits))
    counts = b.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    same = [b[c].eqNullSafe(counts[c]) for c in (*group, "__bucket")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    inner = Window.partitionBy(*[b[c] for c in (*group, "__bucket")]).orderBy(b[key_hex], *[b[c] for c in ties])
    out = b.join(counts, on, "left").select(*[b[c] for c in df.columns], (counts["__before"] + F.row_number().over(inner)).alias(name))
    return out


def _layout(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows range-partitioned by (group, order), with `__part`; the layout is fixed by a reliable checkpoint."""
    return cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id()))


def _key(group: list[str]) -> Column:
    """One join key for a group; null groups are groups, as structs of nulls are equal."""
    return F.struct(*[F.col(g) for g in group]) if group else F.lit(0)


def positions(df: DataFrame, group: list[str], order: list[Column], *, name: str = "pos") -> DataFrame:
    """Adds the position from 1 within the group by any total order.

    Counts per range partition give the offsets, so a group of any size is numbered by many tasks.
    """
    fixed = _layout(df, group, order).withColumn("__g", _key(group))
    counts = fixed.groupBy("__g", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__g", "__part").orderBy(*order))
    return fixed.withColumn("__local", local).join(counts, ["__g", "__part"]).withColumn(name, F.col("__local") + F.col("__before")).select(*df.columns, name)


def previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the group's order (ascending, total); null for the first. The last row of each
    range partition is handed on, so a group of any size is worked off by many tasks."""
    fixed = _layout(df, group, [F.col(c) for c in order]).withColumn("__g", _key(group))
    inner = Window.partitionBy("__g", "__part").orderBy(*order)
    last = fixed.groupBy("__g", "__part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("__g", "__part", F.last("__last").over(before).alias("__carry"))
    at = F.lag(F.struct(F.col(value).alias("v"))).over(inner)
    return fixed.withColumn("__at", at).join(last, ["__g", "__part"]).withColumn(name, F.coalesce("__at", "__carry")["v"]).select(*df.columns, name)


def greatest_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value of all earlier rows in the group's order (ascending, total); null for the first row."""
    fixed = _layout(df, group, [F.col(c) for c in order]).withColumn("__g", _key(group))
    inner = Window.partitionBy("__g", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = fixed.groupBy("__g", "__part").agg(F.max(value).alias("__top"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select("__g", "__part", F.max("__top").over(before).alias("__carry"))
    return fixed.withColumn("__in", F.max(value).over(inner)).join(top, ["__g", "__part"]).withColumn(name, F.greatest("__in", "__carry")).select(*df.columns, name)
