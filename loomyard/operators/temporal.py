"""Time series helpers: forward as-of, grids, rolling sums, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_backward
from .ranking import positions, previous


def asof_forward(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, values: list[str], *, bucket_width: int, prefix: str = "next_") -> DataFrame:
    """Each left row with the first right row at or after its time (the mirrored backward join); none gives null."""
    mirrored = right.withColumn("__at", -F.col(right_time))
    out = asof_backward(left.withColumn("__lt", -F.col(left_time)), mirrored, entity, "__lt", "__at", values, bucket_width=bucket_width, prefix=prefix)
    return out.drop("__lt")


def grid_floor(c: str, width: int) -> Column:
    """Start of the grid cell that holds an epoch value (right for negative values too)."""
    return F.expr(f"({c} div {width}L - if({c} % {width}L < 0, 1, 0)) * {width}L")


def rolling_sum(df: DataFrame, group: list[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """(group, order, name): the sum over each row and the n-1 rows before it, null until n rows are there.

    Every row is handed to the n rows it counts for, by position, and summed: no task holds a group.
    """
    p = positions(df.select(*group, order, value), group, [F.col(order)], name="__p")
    to = F.explode(F.sequence(F.col("__p"), F.col("__p") + n - 1)).alias("__to")
    g = p.select(*group, "__p", order, value, to).groupBy(*group, "__to")
    out = g.agg(F.count("*").alias("__n"), F.sum(value).alias("__s"), F.max(F.when(F.col("__p") == F.col("__to"), F.col(order))).alias(order), F.max((F.col("__p") == F.col("__to")).cast("int")).alias("__own"))
    return out.where("__own = 1").select(*group, order, F.when(F.col("__n") == n, F.col("__s")).alias(name))


def gaps(df: DataFrame, entity: str, at: str, tie: str) -> DataFrame:
    """Rows with the time since the row before in their entity (null for the first)."""
    return previous(df, [entity], [at, tie], at, "__before").withColumn("gap", F.col(at) - F.col("__before")).drop("__before")


def every_kth(df: DataFrame, entity: str, order: list[str], k: int) -> DataFrame:
    """Rows 1, k+1, 2k+1... of each entity."""
    return positions(df, [entity], [F.col(c) for c in order], name="__n").where((F.col("__n") - 1) % k == 0).drop("__n")


def unzip_series(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays to one row per position; arrays of unequal length are padded with nulls."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))


def sun_elevation(us: Column, lat: Column, lon: Column) -> Column:
    """Solar elevation in degrees by the published NOAA low-precision equations, as a column expression."""
    # The coefficients of the NOAA solar calculator, after Meeus, Astronomical Algorithms, chapters 22, 25 and 28.
    day = us / F.lit(86_400_000_000.0)
    t = (day - 10957.5) / 36525.0  # Julian centuries since 2000-01-01 12:00
    rad = F.radians
    mean_long = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = 357.52911 + t * (35999.05029 - 0.0001537 * t)
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(rad(anomaly)) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(rad(2 * anomaly)) * (0.019993 - 0.000101 * t) + F.sin(rad(3 * anomaly)) * 0.000289
    omega = rad(125.04 - 1934.136 * t)
    apparent = mean_long + centre - 0.00569 - 0.00478 * F.sin(omega)
    tilt0 = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60
    tilt = rad(tilt0 + 0.00256 * F.cos(omega))
    decl = F.asin(F.sin(tilt) * F.sin(rad(apparent)))
    y = F.pow(F.tan(tilt / 2), 2)
    m, l0 = rad(anomaly), rad(mean_long)
    eot = 4 * F.degrees(y * F.sin(2 * l0) - 2 * ecc * F.sin(m) + 4 * ecc * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * ecc * ecc * F.sin(2 * m))
    minutes = F.pmod(F.pmod(us, F.lit(86_400_000_000)) / F.lit(60_000_000.0) + eot + 4 * lon, F.lit(1440.0))
    angle = rad(minutes / 4 - 180)
    s = F.sin(rad(lat)) * F.sin(decl) + F.cos(rad(lat)) * F.cos(decl) * F.cos(angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
