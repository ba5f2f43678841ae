"""Sample matching target category proportions (problem 5).

Method: one pass over the rows keeps a mergeable reservoir per category: the distinct keys, filed by hash in slots of the
hash range, with their counts. Two reservoirs merge slot by slot. After the final counts every reservoir is trimmed
uniformly to its feasible quota: the slots below the quota are kept whole, the one that holds the quota's last key is cut
by rank, the rest is dropped. Categories with fewer keys than their quota are reported as exhausted.

Scale: the table is read once, and its distinct keys are written to the shared folder. Slots are SLOTS per category, so
one with a third of all rows is never in one task, and the rows beyond the quota are dropped before they are ranked.
Slot counts are pre-aggregated. Nothing but the size of the target table reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_hex, norm_category, norm_key
from ..session import cut

CATEGORY = ["source_city", "scenario_type"]
#: Hex digits of the hash that name a slot: 4,096 slots.
DIGITS = 3


def normal_targets(targets: DataFrame) -> DataFrame:
    """Targets with normal category names; of repeated ones the greatest shares hold. Blank or null names are left out."""
    t = targets.select(norm_category("source_city").alias("source_city"), norm_category("scenario_type").alias("scenario_type"), "target_permille", "min_rows")
    t = t.where("source_city is not null and scenario_type is not null")
    return t.groupBy("source_city", "scenario_type").agg(F.max(F.coalesce("target_permille", F.lit(0))).alias("target_permille"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))


def normal_rows(rows: DataFrame) -> DataFrame:
    """(source_city, scenario_type, scenario_id) in normal form; rows with a null or blank category or a null id don't count."""
    r = rows.select(norm_category("source_city").alias("source_city"), norm_category("scenario_type").alias("scenario_type"), norm_key("scenario_id").alias("scenario_id"))
    return r.where("source_city is not null and scenario_type is not null and scenario_id is not null")


def reservoirs(rows: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """(keys, number of distinct keys over all categories). A key is filed in each category it has, once."""
    ids = rows.groupBy("scenario_id").agg(F.collect_set(F.struct(*CATEGORY)).alias("of"))
    ids = cut(ids.withColumn("key_hash", hash_hex(salt, F.col("scenario_id"))))
    keys = ids.select("scenario_id", "key_hash", F.explode("of").alias("c")).select("c.*", "scenario_id", "key_hash")
    return keys.withColumn("slot", F.substring("key_hash", 1, DIGITS)), ids.agg(F.count("*").alias("total"))


def target_sample(rows: DataFrame, targets: DataFrame, *, salt: str = "target-sample") -> tuple[DataFrame, DataFrame]:
    """(sample, report). The sample has (source_city, scenario_type, scenario_id, rank), each id once per category.

    The report has one row per target: target_permille, min_rows, available (distinct ids), quota, drawn, shortfall
    and exhausted (fewer ids than the quota). The quota is greatest(min_rows, (S * permille + 500) div 1000) with S a fifth
    of all distinct ids. Categories without a target aren't drawn from. Repeated rows count once. Empty tables give an
    empty sample; targets then have quota min_rows. The target table is broadcast: at most 100,000 rows (checked).
    """
    t = normal_targets(targets)
    if t.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 targets; draw them in blocks")
    keys, total = reservoirs(normal_rows(rows), salt)
    quota = F.greatest("min_rows", F.expr("(total div 5 * target_permille + 500) div 1000"))
    quotas = t.crossJoin(F.broadcast(total)).withColumn("quota", quota).drop("total")  # total is one row
    slots = keys.groupBy(*CATEGORY, "slot").agg(F.count("*").alias("n"))
    slots = slots.join(F.broadcast(quotas), CATEGORY)
    before = Window.partitionBy(*CATEGORY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = slots.groupBy(*CATEGORY).agg(F.sum("n").alias("available"), F.sum(F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before")))).alias("drawn"))
    report = quotas.join(held, CATEGORY, "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.select(*CATEGORY, "target_permille", "min_rows", "available", "quota", "drawn", (F.col("quota") - F.col("drawn")).alias("shortfall"), (F.col("drawn") < F.col("quota")).alias("exhausted"))
    kept = slots.where("before < quota").select(*CATEGORY, "slot", "before", "quota")
    inner = Window.partitionBy(*CATEGORY, "slot").orderBy("key_hash", "scenario_id")
    ranked = keys.join(kept, [*CATEGORY, "slot"]).withColumn("rank", F.col("before") + F.row_number().over(inner))
    return ranked.where("rank <= quota").select(*CATEGORY, "scenario_id", "rank"), report


def noted_shortfalls(groups: DataFrame, cut: str = "5") -> DataFrame:
    """Groups whose noted shortfall at `cut` is null or not greatest(0, cut - ranked); groups listed twice count once."""
    noted = F.col("cuts")[cut]["shortfall"]
    g = groups.select(norm_category("source_city").alias("source_city"), norm_category("scenario_type").alias("scenario_type"), noted.alias("noted"), "ranked")
    wrong = F.col("noted").isNull() | (F.col("noted") != F.greatest(F.lit(0), F.lit(int(cut)) - F.col("ranked")))
    return g.where(F.col("source_city").isNotNull() & F.col("scenario_type").isNotNull() & wrong).select("source_city", "scenario_type").distinct()
