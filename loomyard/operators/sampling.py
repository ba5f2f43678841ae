"""Deterministic ranking, non-overlap acceptance, quotas, splits and folds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_hex
from .asof import asof_backward
from .intervals import merge_intervals
from .ranking import greatest_before, ranked_by_hash


def rank_key(seed: int, key: str) -> Column:
    """Hash rank of a key: sorts like the unsigned number it is."""
    return hash_hex(str(seed), F.col(key).cast("string"))


def accept_without_overlap(df: DataFrame, scope: str, start: str, end: str, order: Sequence[str], *, bucket_width: int) -> DataFrame:
    """Rows accepted greedily in `order` (ascending; make it total): one is taken iff its [start, end) meets no taken one of its scope.

    Windows in different continuous periods of a scope can't meet, so (scope, period) is the unit of work: a long drive
    is spread over its periods. A task streams its rows in order and holds only what it has accepted. Rows with a null
    scope or bound, or end <= start, are never accepted.
    """
    ok = df.where(F.col(scope).isNotNull() & (F.col(end) > F.col(start)))
    periods = merge_intervals(ok, scope, start, end, bucket_width=bucket_width).where("kind = 'period'").select(F.col(scope), F.col("start").alias("period"))
    rows = asof_backward(ok, periods, scope, start, "period", ["period"], bucket_width=bucket_width, prefix="__")
    names = rows.columns
    at = [names.index(scope), names.index("__period"), names.index(start), names.index(end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, starts, ends = None, [], []
        for batch in batches:
            take = []
            for i, (s, p, a, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                if (s, p) != key:
                    key, starts, ends = (s, p), [], []
                k = bisect_right(starts, a)
                if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < z):
                    continue
                starts.insert(k, a)
                ends.insert(k, z)
                take.append(i)
            if take:
                yield batch.take(pa.array(take))

    sorted_rows = rows.repartition(F.col(scope), F.col("__period")).sortWithinPartitions(scope, "__period", *order)
    return sorted_rows.mapInArrow(run, rows.schema).drop("__period")


def greedy_ranking(df: DataFrame, *, city: str, kind: str, scope: str, start: str, end: str, key: str, seed: int, bucket_width: int) -> DataFrame:
    """Non-overlapping rows with rank_key and group_rank (1.. within city and kind, by rank_key then key).

    Cities ascending, rarest kinds first (by rows of the group before acceptance, then name), rows by hash; acceptance
    is per scope across kinds.
    """
    sizes = df.groupBy(city, kind).agg(F.count("*").alias("group_size"))
    rows = df.join(sizes, [city, kind]).withColumn("rank_key", rank_key(seed, key)).withColumn("__scope", F.concat_ws("|", city, F.col(scope).cast("string")))
    taken = accept_without_overlap(rows, "__scope", start, end, ["group_size", kind, "rank_key", key], bucket_width=bucket_width).drop("__scope")
    return ranked_by_hash(taken, [city, kind], "rank_key", [key], name="group_rank")


def quota_sample(df: DataFrame, *, city: str, kind: str, scope: str, start: str, end: str, key: str, seed: int, quota: int, refuse: bool = True) -> DataFrame:
    """The variant that stops at `quota` rows per kind, so that fewer windows are claimed. Kinds go from rare to common.
    A kind that falls short raises when the plan runs, unless `refuse` is false (a pilot sample, which may fall short).

    Stopping couples the scopes of a city, so a city is the unit of work and its rows are streamed in order through one
    task, which holds only the accepted windows (at most quota per kind).
    """
    sizes = df.groupBy(city, kind).agg(F.count("*").alias("group_size"))
    rows = df.join(sizes, [city, kind]).withColumn("rank_key", rank_key(seed, key))
    names = rows.columns
    at = [names.index(c) for c in (city, kind, scope, start, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, held = None, {}, {}
        for batch in batches:
            take = []
            for i, (c, k, s, a, z) in enumerate(zip(*(batch.column(x).to_pylist() for x in at))):
                if c != place:
                    place, n, held = c, {}, {}
                if n.get(k, 0) >= quota or any(a < y and x < z for x, y in held.get(s, ())):
                    continue
                n[k] = n.get(k, 0) + 1
                held.setdefault(s, []).append((a, z))
                take.append(i)
            if take:
                yield batch.take(pa.array(take))

    taken = rows.repartition(F.col(city)).sortWithinPartitions(city, "group_size", kind, "rank_key", key).mapInArrow(run, rows.schema)
    if not refuse:
        return taken
    n = taken.groupBy(city, kind).agg(F.count("*").alias("__n"))
    checked = sizes.join(n, [city, kind], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    short = F.concat_ws(" ", F.lit("short of the quota:"), F.col(city).cast("string"), F.col(kind).cast("string"), F.col("__n").cast("string"))
    checked = checked.select(city, kind, F.when(F.col("__n") < quota, F.raise_error(short)).otherwise(F.lit(True)).alias("__ok"))
    return checked.join(taken, [city, kind], "left").where("__ok").select(*taken.columns)


def split_counts(n: int, shares: Sequence[float]) -> list[int]:
    """How many of n units go to (train, validation, test): half-even rounding, the rest to train.

    From 3 units on, every split with a positive share has at least one, taken from the larger of validation and test
    (ties: the last); a split with share 0 has none, and what would be left for it goes to the first with a share.
    """
    if min(shares) < 0 or abs(sum(map(Decimal, map(str, shares))) - 1) > Decimal("1e-9"):
        raise ValueError("shares must not be negative and must add up to 1")
    val, test = (int((Decimal(str(s)) * n).quantize(Decimal(1), ROUND_HALF_EVEN)) for s in shares[1:])
    if n >= 3:
        val, test = (max(x, 1) if s > 0 else 0 for x, s in ((val, shares[1]), (test, shares[2])))
    least = 1 if n >= 3 and shares[0] > 0 else 0
    while n - val - test < least:
        if val > test:
            val -= 1
        else:
            test -= 1
    out = [n - val - test, val, test]
    if shares[0] == 0:
        first = 1 if shares[1] > 0 else 2
        out[first] += out[0]
        out[0] = 0
    return out


def group_split(units: DataFrame, group: str, unit: str, *, seed: int, shares: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(group, unit, split): the distinct units of each group in hash order, cut at the group's split counts.

    A unit that stands in two groups would get two splits: that raises when the plan runs. A null unit is a unit; rows
    with a null group take no part.
    """
    u = units.where(F.col(group).isNotNull()).select(group, unit).groupBy(unit).agg(F.min(group).alias("__a"), F.max(group).alias("__z"))
    two = F.when(F.col("__a") != F.col("__z"), F.raise_error(F.concat(F.lit("a unit stands in two groups: "), F.col(unit).cast("string")))).otherwise(F.col("__a"))
    u = u.select(two.alias(group), unit).withColumn("h", hash_hex(f"{seed}:split", F.col(unit).cast("string")))
    ranked = ranked_by_hash(u, [group], "h", [unit], name="place")
    sizes = {r[0]: r[1] for r in u.groupBy(group).count().limit(100_001).collect()}
    if len(sizes) > 100_000:
        raise ValueError("too many groups for a table of split counts")
    rows = [(g, *split_counts(n, shares)) for g, n in sizes.items()]
    kind = units.schema[group].dataType.simpleString()
    counts = units.sparkSession.createDataFrame(rows, f"`{group}` {kind}, n_train int, n_val int, n_test int")
    split = F.when(F.col("place") <= F.col("n_train"), "train").when(F.col("place") <= F.col("n_train") + F.col("n_val"), "validation").otherwise("test")
    return ranked.join(F.broadcast(counts), group).select(group, unit, split.alias("split"))


def balanced_folds(rows: DataFrame, unit: str, item: str, *, folds: int, seed: int, most_units: int = 1_000_000) -> DataFrame:
    """(unit, size, fold): units by falling number of distinct items, then hash, each to the least loaded fold (lowest on ties).

    Sequential by definition; only (unit, size, hash) reach the driver, at most most_units of them (checked).
    """
    sizes = rows.groupBy(unit).agg(F.countDistinct(item).alias("size")).withColumn("h", hash_hex(str(seed), F.col(unit).cast("string")))
    ordered = sizes.orderBy(F.desc("size"), "h", unit).limit(most_units + 1).collect()
    if len(ordered) > most_units:
        raise ValueError("too many units for sequential folds")
    load, out = [0] * folds, []
    for r in ordered:
        f = load.index(min(load))
        load[f] += r["size"]
        out.append((r[unit], r["size"], f))
    return rows.sparkSession.createDataFrame(out, f"`{unit}` {rows.schema[unit].dataType.simpleString()}, size long, fold int")


def leaking_units(df: DataFrame, unit: str, split: str) -> DataFrame:
    """(unit, splits): units whose rows stand in more than one split or fold, with the sorted names; none means no leak."""
    g = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.array_sort(F.collect_set(F.col(split).cast("string"))).alias("splits"))
    return g.where(F.size("splits") > 1).select(unit, F.array_join("splits", "|").alias("splits"))


def fold_sizes(rows: DataFrame, folds: DataFrame, unit: str, fold: str) -> DataFrame:
    """(fold, n_test, n_train) of the index splits: a fold's rows are tested, all others train."""
    n = rows.join(folds.select(unit, fold), unit).groupBy(fold).agg(F.count("*").alias("n_test"))
    total = n.agg(F.sum("n_test").alias("n_all"))
    return n.crossJoin(F.broadcast(total)).select(fold, "n_test", (F.col("n_all") - F.col("n_test")).alias("n_train"))  # one row


def first_n(ranked: DataFrame, n: int, rank: str = "group_rank") -> DataFrame:
    """Prefix cut; cuts of growing n are nested."""
    return ranked.where(F.col(rank) <= n)


def overlap_offenders(df: DataFrame, scope: str, start: str, end: str, key: str) -> DataFrame:
    """Rows whose window begins before an earlier one of the scope (by start, end, key) has ended; half-open windows."""
    return greatest_before(df, [scope], [start, end, key], end, "__reach").where(F.col(start) < F.col("__reach")).drop("__reach")


def complete_counts(df: DataFrame, a: str, b: str, domain_a: DataFrame, domain_b: DataFrame) -> DataFrame:
    """Counts over the full domain a x b (dimension tables), zero where there is no row."""
    grid = domain_a.select(a).distinct().crossJoin(F.broadcast(domain_b.select(b).distinct()))
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])
