"""Matching records by nearest time (problem 2).

Method: union both tables, sort per entity and time, carry the last and the next right-side record onto the left rows
and choose the nearer one within the tolerance.

Scale: the sort key is (entity, time bucket). A bucket is many times as wide as the tolerance; right rows within the
tolerance of a border are put into the neighbouring bucket too, so every bucket is complete on its own and one entity
with a third of all rows is spread over all its buckets. Right rows in buckets without left rows are dropped before the
sort by a semi join, which needs no broadcast. Readings of one instant are reduced to the smallest id before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import bucket_of


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, entity: str, left_time: str, right_time: str, right_id: str, tolerance: int, bucket_width: int | None = None
) -> DataFrame:
    """The left rows that have a right record of the same entity at most `tolerance` away (inclusive), with its id.

    Among equal distances the earlier record wins, then the smaller id. Rows with a null entity or time take no part.
    Left rows are kept with all their columns; equal left rows each get their match. The id comes as column right_id,
    which must not be a column of the left. Empty tables give an empty result.
    """
    width = bucket_width or 100 * max(tolerance, 1)
    if width < 2 * tolerance + 2:
        raise ValueError("bucket_width must be more than twice the tolerance")
    if right_id in left.columns:
        raise ValueError(f"the left table already has a column {right_id}")
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.where(F.col(f"`{entity}`").isNotNull() & F.col(f"`{left_time}`").isNotNull())
    a = a.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{left_time}`").cast("long").alias("u"), row.alias("row")).withColumn("b", bucket_of("u", width))
    r = right.where(F.col(entity).isNotNull() & F.col(right_time).isNotNull() & F.col(right_id).isNotNull())
    r = r.select(F.col(entity).alias("e"), F.col(right_time).cast("long").alias("u"), F.col(right_id).alias("id"))
    r = r.withColumn("lo", F.col("u") - tolerance).withColumn("hi", F.col("u") + tolerance)
    r = r.withColumn("b", F.explode(F.array_distinct(F.array(bucket_of("lo", width), bucket_of("hi", width)))))
    r = r.join(a.select("e", "b").distinct(), ["e", "b"], "left_semi").groupBy("e", "b", "u").agg(F.min("id").alias("id"))
    none_row = F.lit(None).cast(a.schema["row"].dataType)
    none_id = F.lit(None).cast(right.schema[right_id].dataType)
    both = a.select("e", "b", "u", F.lit(1).alias("side"), "row", none_id.alias("id")).unionByName(r.select("e", "b", "u", F.lit(0).alias("side"), none_row.alias("row"), "id"))
    reading = F.when(F.col("side") == 0, F.struct("u", "id"))
    order = Window.partitionBy("e", "b").orderBy("u", "side")
    both = both.withColumn("before", F.last(reading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The next one by the mirrored order, so that this too is a running value.
    back = Window.partitionBy("e", "b").orderBy(F.col("u").desc(), F.col("side").desc())
    both = both.withColumn("after", F.last(reading, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d_before, d_after = F.col("u") - F.col("before.u"), F.col("after.u") - F.col("u")
    pick = F.when(d_before.isNotNull() & (d_before <= tolerance) & (d_after.isNull() | (d_before <= d_after)), F.col("before.id")).when(d_after <= tolerance, F.col("after.id"))
    return both.where("side = 1").select("row", pick.alias("id")).where("id is not null").select("row.*", F.col("id").alias(right_id))
