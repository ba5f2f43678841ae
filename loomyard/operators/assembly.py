"""Assembling tables: checked joins, coverage, identity, reasons for exclusion, encodings, look-ups.

A check that is part of a join raises when the plan runs; the same figures come as rows from coverage() and mismatches().
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def unique_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The rows, one per key; a repeated key raises when the plan runs. Rows with a null key are left out, as a join would."""
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    rest = [c for c in df.columns if c not in keys]
    one = df.where(known).groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in rest])
    ok = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{name}: key is not unique"))).otherwise(F.lit(True))
    return one.where(ok).select(*df.columns)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on a composite key that must be unique on both sides."""
    return unique_by(left, keys, "left").join(unique_by(right, keys, "right"), list(keys), how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a side that must be unique by the key; left rows are neither lost nor doubled."""
    return left.join(unique_by(right, keys, "right"), list(keys), "left")


def coverage(left: DataFrame, right: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """(n_keys, n_absent, sample): distinct keys of left, those that right lacks, the first few of them in order."""
    keys = left.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k")).distinct()
    have = right.select(F.col(key).cast("string").alias("k"), F.lit(True).alias("there")).distinct()
    lack = keys.join(have, "k", "left")
    first = lack.where("there is null").orderBy("k").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("sample"))
    n = lack.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("there").isNull(), 1)).alias("n_absent"))
    return n.crossJoin(F.broadcast(first))  # one row each


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, n_compared, n_mismatch): rows of left against the row of right with its key, null equal to null."""
    r = unique_by(right.select(key, *columns), [key], "right").select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = left.join(r, F.col(key) == F.col("__k"))
    row = j.agg(F.count("*").alias("n"), *[F.count(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), 1)).alias(f"m{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_compared"), F.col(f"m{i}").alias("n_mismatch")) for i, c in enumerate(columns)])))


def join_checked(left: DataFrame, right: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Inner one-to-one join in which every left key must be covered and the identity columns of both sides must agree."""
    r = unique_by(right, [key], "right").withColumn("__there", F.lit(True)).withColumnsRenamed({c: f"__{c}" for c in identity})
    j = unique_by(left, [key], "left").join(r, key, "left")
    agree = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity], F.lit(True))
    ok = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("not covered: "), F.col(key).cast("string")))).when(~agree, F.raise_error(F.concat(F.lit("identity differs: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return j.where(ok).drop("__there", *[f"__{c}" for c in identity])


def frame(bases: Mapping[str, DataFrame], sources: Mapping[str, DataFrame], key: str, tag: str = "subset") -> DataFrame:
    """Several base tables under a tag, each left-joined to sources that must be unique by the key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in bases.items()])
    for name, s in sources.items():
        rows = rows.join(unique_by(s, [key], name), key, "left")
    return rows


def align(rows: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with their prediction; a row without one, a repeated one or one for no row raises when the plan runs."""
    p = unique_by(predictions.select(key, value), [key], "predictions").withColumn("__p", F.lit(True))
    j = unique_by(rows, [key], "rows").withColumn("__r", F.lit(True)).join(p, key, "full_outer")
    off = F.when(F.col("__p").isNull(), F.raise_error(F.lit("a row has no prediction"))).when(F.col("__r").isNull(), F.raise_error(F.lit("a prediction has no row"))).otherwise(F.lit(True))
    return j.where(off).drop("__p", "__r")


def reasons(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, n, reasons): per key which rules hold for any of its rows, in the order of the rules, each once; keys without
    any are left out. A null condition doesn't hold."""
    order = list(rules)
    held = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"__{i}") for i, c in enumerate(rules.values())])
    text = F.array_join(F.filter(F.array(*[F.when(F.col(f"__{i}"), F.lit(r)) for i, r in enumerate(order)]), lambda x: x.isNotNull()), "; ")
    return held.select(*keys, "n", text.alias("reasons")).where("reasons <> ''")


def disagreements(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], absent: str = "<absent>") -> DataFrame:
    """(key, column, left, right), as text: every value in which two tables differ; `absent` where a side lacks the key."""
    left = a.select(F.col(key).alias("k"), F.lit(True).alias("here"), *[F.col(c).cast("string").alias(f"l_{c}") for c in columns])
    right = b.select(F.col(key).alias("k"), F.lit(True).alias("there"), *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    text = lambda side, c: F.when(F.col(side).isNull(), absent).otherwise(F.col(c))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text("here", f"l_{c}").alias("left"), text("there", f"r_{c}").alias("right")) for c in columns]))
    out = left.join(right, "k", "full_outer").select("k", each.alias("x")).select(F.col("k").alias(key), "x.*")
    return out.where(~F.col("left").eqNullSafe(F.col("right")))


def mapped(c: Column, names: Mapping[str, str], unknown: str = "unmapped", null: str = "null") -> Column:
    """Dictionary look-up; what the dictionary lacks is `unknown`, null is `null`."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(c.isNull(), null).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(unknown)))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """A decision table: the result of the first rule that holds."""
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(default)


def gated(gates: Sequence[str], strict: str | None = None) -> Column:
    """Is any multiplier 0 or less, or `strict` below 1? Null gates say nothing."""
    low = F.least(*[F.col(c) for c in gates]) <= 0 if len(gates) > 1 else F.col(gates[0]) <= 0
    return F.coalesce(low, F.lit(False)) | (F.coalesce(F.col(strict) < 1, F.lit(False)) if strict else F.lit(False))


def conform(df: DataFrame, columns: Mapping[str, str], **constants: object) -> DataFrame:
    """Renamed (new name: old name) and ordered columns, then constant ones."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()], *[F.lit(v).alias(k) for k, v in constants.items()])


def split_by_null(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have a value, rows that don't)."""
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())


def column_kinds(df: DataFrame) -> dict[str, str]:
    """numeric, boolean, categorical or nested, from the schema alone."""
    kind = lambda t: "boolean" if isinstance(t, T.BooleanType) else "numeric" if isinstance(t, T.NumericType) else "nested" if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else "categorical"
    return {f.name: kind(f.dataType) for f in df.schema}


def model_frame(df: DataFrame, features: Sequence[str], missing: str = "__missing__") -> DataFrame:
    """Features in the form models take: booleans as 0 and 1, numbers as doubles, the rest as text with nulls as `missing`."""
    kinds = column_kinds(df.select(*features))
    if nested := [c for c, k in kinds.items() if k == "nested"]:
        raise ValueError(f"nested columns: {nested}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c)
    return df.select(*[c for c in df.columns if c not in features], *[text(c) if kinds[c] == "categorical" else F.col(c).cast("double").alias(c) for c in features])


def singleton(df: DataFrame, group: Sequence[str], choice: str, prefer: str, values: Sequence[str]) -> DataFrame:
    """Per group its only row, else its only row with `choice` = `prefer`; anything else raises when the plan runs."""
    v = F.struct(*[F.col(c) for c in values])
    liked = F.col(choice) == prefer
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.count(F.when(liked, 1)).alias("m"), F.first(v).alias("a"), F.first(F.when(liked, v), ignorenulls=True).alias("b"))
    one = F.when(F.col("n") == 1, F.col("a")).when(F.col("m") == 1, F.col("b")).otherwise(F.raise_error(F.lit("no single row")))
    return g.select(*group, one.alias("v")).select(*group, "v.*")


def normal_records(c: Column, key: str, value: str) -> Column:
    """array<struct> of any shape to array<struct<id string, value string>>: null gives an empty array, null ids are dropped."""
    out = F.transform(F.filter(c, lambda x: x[key].isNotNull()), lambda x: F.struct(x[key].cast("string").alias("id"), x[value].cast("string").alias("value")))
    return F.coalesce(out, F.array().cast("array<struct<id: string, value: string>>"))
