"""Reproducible sample that stays stable as the data grow (problem 6).

Method: hash the record key with a fixed salt to the unit interval and keep the values below the rate. Whether a key is
in depends on the key and the salt alone: not on partitions, order, or other rows; a larger rate gives a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_hex, norm_category, norm_key
from ..operators.ranking import ranked_by_hash


def below_rate(key_hex: Column, rate: float) -> Column:
    """Is the hash, as a fraction of 2**64 in steps of 2**-32, below the rate? 0 keeps none, 1 keeps all."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    steps = round(rate * 2**32)
    return F.conv(F.substring(key_hex, 1, 8), 16, 10).cast("long") < F.lit(steps)


def stable_sample(df: DataFrame, key: str, *, rate: float, salt: str) -> DataFrame:
    """The rows whose key is selected, with all their columns. Rows with a null key are never selected.

    Keys are compared trimmed and in lower case. All rows of a selected key are kept, repeats too.
    """
    return df.where(norm_key(f"`{key}`").isNotNull() & below_rate(hash_hex(salt, norm_key(f"`{key}`")), rate))


def stable_sample_ordered(df: DataFrame, key: str, *, city: str, kind: str, at: str, tie: str, rate: float, salt: str) -> DataFrame:
    """One row per selected key with its city, type and its place there: (key, city, kind, key_hash, ranked).

    A key has the city and type of its first delivery (least `at`, then `tie`; rows without a time come last), so later
    deliveries change neither the choice nor the place's group. Blank and null categories are null and form groups.
    """
    kept = stable_sample(df, key, rate=rate, salt=salt)
    first = F.struct(F.col(at).isNull().alias("late"), F.col(at).alias("at"), F.col(tie).alias("tie"), norm_category(city).alias("c"), norm_category(kind).alias("k"))
    one = kept.groupBy(norm_key(key).alias(key)).agg(F.min(first).alias("f")).select(key, F.col("f.c").alias(city), F.col("f.k").alias(kind))
    one = one.withColumn("key_hash", hash_hex(salt, F.col(key)))
    return ranked_by_hash(one, [city, kind], "key_hash", [key], name="ranked")
