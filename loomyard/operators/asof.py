"""As-of joins without a theta join: union both sides, sort per entity and time, carry the last right row.

Keys are (entity, time bucket); an entity with a third of all rows is spread over its buckets. What a bucket needs from
earlier ones comes as one carry row per (entity, bucket) out of pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(c: str, width: int) -> F.Column:
    """Floor division that is right for negative values and never leaves the long range."""
    return F.expr(f"`{c}` div {width}L - if(`{c}` % {width}L < 0, 1, 0)")


def asof_backward(
    left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, values: list[str], *, bucket_width: int, prefix: str = "asof_"
) -> DataFrame:
    """Each left row with `values` of the right row of the same entity with the greatest right_time <= left_time.

    No such row, a null entity or a null left_time give null values; no left row is lost or doubled. Among right rows
    of equal time the greatest struct of `values` wins. Right rows with a null entity or time take no part. Columns of
    the left keep their names; those of the right come as prefix + name, so names can't clash.
    """
    payload = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    r = right.where(F.col(entity).isNotNull() & F.col(right_time).isNotNull()).select(F.col(entity).alias("e"), F.col(right_time).cast("long").alias("u"), payload.alias("v"))
    r = r.groupBy("e", "u").agg(F.max("v").alias("v")).withColumn("b", bucket_of("u", bucket_width))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    known = F.col(f"`{entity}`").isNotNull() & F.col(f"`{left_time}`").isNotNull()
    full = left.select(row.alias("row"), F.col(f"`{entity}`").alias("e"), F.col(f"`{left_time}`").cast("long").alias("u"), known.alias("known"))
    m = full.where("known").select("e", "u", "row").withColumn("b", bucket_of("u", bucket_width))
    # The last right row before each bucket that has left rows.
    tops = r.groupBy("e", "b").agg(F.max_by(F.struct("u", "v"), "u").alias("top"))
    marks = m.select("e", "b").distinct().join(tops, ["e", "b"], "full_outer")
    earlier = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.withColumn("c", F.last("top", ignorenulls=True).over(earlier)).where(F.col("c").isNotNull()).select("e", "b", F.col("c.u").alias("u"), F.col("c.v").alias("v"))
    none_row, none_v = F.lit(None).cast(full.schema["row"].dataType), F.lit(None).cast(r.schema["v"].dataType)
    both = (
        m.select("e", "b", "u", F.lit(1).alias("side"), "row", none_v.alias("v"))
        .unionByName(r.select("e", "b", "u", F.lit(0).alias("side"), none_row.alias("row"), "v"))
        .unionByName(carry.select("e", "b", "u", F.lit(0).alias("side"), none_row.alias("row"), "v"))
    )
    w = Window.partitionBy("e", "b").orderBy("u", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row", "v")
    out = hit.unionByName(full.where("not known").select("row", none_v.alias("v")))
    return out.select("row.*", *[F.col(f"v.v{i}").alias(f"{prefix}{c}") for i, c in enumerate(values)])
