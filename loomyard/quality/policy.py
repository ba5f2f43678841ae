"""The missing-data policies of a contract, carried out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import Contract


def missing(contract: Contract, df: DataFrame, succeeded: str | None = None) -> dict[str, Column]:
    """Per declared field that is there, when its value counts as missing: never where the policy says that it doesn't apply."""
    out = {}
    for f in contract.fields:
        if f.name in df.columns:
            null = F.col(f"`{f.name}`").isNull()
            if f.missing == "not_applicable_when_succeeded" and succeeded:
                null = null & ~F.coalesce(F.col(succeeded), F.lit(False))
            out[f.name] = null
    return out


def apply(df: DataFrame, contract: Contract, *, succeeded: str | None = None, constants: dict[str, object] | None = None) -> DataFrame:
    """Rows after the policies: exclude_pair drops the row, null_with_indicator adds <name>_missing,
    constant_from_metadata fills in, fail_validation raises when the plan runs, not_applicable_when_succeeded leaves null."""
    null, constants = missing(contract, df, succeeded), constants or {}
    by = {p: [f.name for f in contract.fields if f.missing == p and f.name in null] for p in {f.missing for f in contract.fields}}
    for c in by.get("fail_validation", ()):
        df = df.where(F.when(null[c], F.raise_error(F.lit(f"{c}: missing"))).otherwise(F.lit(True)))
    for c in by.get("constant_from_metadata", ()):
        df = df.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(constants.get(c))))
    if out := by.get("exclude_pair"):
        df = df.where(~reduce(lambda a, b: a | b, [null[c] for c in out]))
    for c in by.get("null_with_indicator", ()):
        df = df.withColumn(f"{c}_missing", null[c])
    return df


def summary(df: DataFrame, contract: Contract, *, succeeded: str | None = None) -> DataFrame:
    """(column, policy, n_missing, n_rows) of every declared field, one pass."""
    null = missing(contract, df, succeeded)
    policy = {f.name: f.missing for f in contract.fields}
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(f"m{i}") for i, c in enumerate(null.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(policy[k]).alias("policy"), F.col(f"m{i}").alias("n_missing"), F.col("n").alias("n_rows")) for i, k in enumerate(null)])))
