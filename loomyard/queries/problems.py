"""Queries of the general data problems 1, 4 and 7, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators.intervals import merge_intervals
from ..operators.orphans import LONG_MAX, LONG_MIN, contiguous_runs, dangling_by_period, dangling_references
from ..operators.packed import explode_packed
from ..session import cut
from ..sources.tables import micros, table

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
MAX_GAP_US = 1_800_000_000


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references as (src_table, src_id, ref_field, entity, key, at) and the runs of keys that exist."""
    outcome = table(spark, d, "planner_outcome", "outcome_id", "scenario_id", "run_id", "succeeded", "recorded_at")
    sample = table(spark, d, "scenario_sample", "scenario_id", "ingested_at", "deleted_at")
    result = table(spark, d, "run_result", "result_id", "run_id", "failed", "finished_at")
    entity = lambda kind, c: F.concat(F.lit(kind + "|"), norm_key(c))
    # Results without a run have no failing outcome; there may be many, so they are spread over keys of their own.
    failed_of = F.coalesce(entity("failed", "run_id"), F.concat(F.lit("no run|"), F.pmod("result_id", F.lit(4096)).cast("string")))
    failing = outcome.where("succeeded = false and scenario_id is not null and run_id is not null").select(norm_key("run_id").alias("run"), norm_key("scenario_id").alias("scenario"))
    failing = failing.distinct().groupBy("run").count()
    keys = (
        sample.select(entity("scenario", "scenario_id").alias("entity"), micros("ingested_at").alias("a"), (F.coalesce(micros("deleted_at"), F.lit(LONG_MAX)) - 1).alias("z"))
        # A run exists at every time; any number of failures from none up to those counted exists.
        .unionByName(result.select(entity("run", "run_id").alias("entity"), F.lit(LONG_MIN).alias("a"), F.lit(LONG_MAX).alias("z")).where("entity is not null").distinct())
        .unionByName(result.select(failed_of.alias("entity"), F.lit(LONG_MIN).alias("a"), F.lit(0).cast("long").alias("z")).distinct())
        .unionByName(failing.select(F.concat(F.lit("failed|"), "run").alias("entity"), F.lit(LONG_MIN).alias("a"), F.col("count").alias("z")))
    )
    at = micros("recorded_at")
    refs = F.array(
        F.struct(F.lit("scenario_id").alias("ref_field"), entity("scenario", "scenario_id").alias("entity")),
        F.struct(F.lit("run_id").alias("ref_field"), entity("run", "run_id").alias("entity")),
    )
    children = (
        outcome.select(F.lit("planner_outcome").alias("src_table"), F.col("outcome_id").alias("src_id"), F.explode(refs).alias("r"), F.coalesce(at, F.lit(LONG_MIN + 1)).alias("key"), F.col("recorded_at").alias("at"))
        .select("src_table", "src_id", "r.ref_field", "r.entity", "key", "at")
        .where("entity is not null")
        .unionByName(
            result.where("failed is not null").select(
                F.lit("run_result").alias("src_table"), F.col("result_id").alias("src_id"), F.lit("failed").alias("ref_field"), failed_of.alias("entity"), F.col("failed").alias("key"), F.col("finished_at").alias("at")
            )
        )
    )
    return children, cut(contiguous_runs(keys, "entity", "a", "z", bucket_width=DAY_US))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    children, runs = _references(spark, d)
    return dangling_references(children, runs, "entity", "key", bucket_width=DAY_US).select("src_table", "src_id", "ref_field")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    children, runs = _references(spark, d)
    return dangling_by_period(dangling_references(children, runs, "entity", "key", bucket_width=DAY_US), "src_table", "ref_field", "at")


_P1 = """
WITH s AS (SELECT lower(trim(scenario_id, {ws})) AS k, ingested_at, deleted_at FROM scenario_sample),
o AS (SELECT outcome_id, lower(trim(scenario_id, {ws})) AS sk, lower(trim(run_id, {ws})) AS rk, succeeded, recorded_at FROM planner_outcome),
r AS (SELECT result_id, lower(trim(run_id, {ws})) AS rk, failed, finished_at FROM run_result),
f AS (SELECT rk, count(DISTINCT sk) AS n FROM o WHERE succeeded = false GROUP BY rk),
found AS (
SELECT 'planner_outcome' AS src_table, outcome_id AS src_id, 'scenario_id' AS ref_field, recorded_at AS ts FROM o
WHERE sk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = o.sk AND s.ingested_at <= o.recorded_at AND (s.deleted_at IS NULL OR s.deleted_at > o.recorded_at))
UNION ALL
SELECT 'planner_outcome', outcome_id, 'run_id', recorded_at FROM o WHERE rk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.rk = o.rk)
UNION ALL
SELECT 'run_result', result_id, 'failed', finished_at FROM r LEFT JOIN f ON f.rk = r.rk WHERE failed > coalesce(f.n, 0))
"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(spark, d, "scenario_sample", "row_id", "all_scenario_tags"), "all_scenario_tags", ["row_id"], value="tag")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenario_sample", "source_recording", "window_start_us", "window_end_us")
    rows = rows.withColumn("source_recording", norm_key("source_recording"))
    out = merge_intervals(rows, "source_recording", "window_start_us", "window_end_us", bucket_width=HOUR_US)
    out = out.where((F.col("kind") == "period") | (F.col("end") - F.col("start") <= MAX_GAP_US))
    return out.select("source_recording", "kind", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


SQL = {
    "p1_found": _P1.format(ws=_WS) + "SELECT src_table, src_id, ref_field FROM found",
    "p1_by_month": _P1.format(ws=_WS) + "SELECT src_table, ref_field, strftime(ts, '%Y-%m') AS month, count(*) AS n_dangling FROM found GROUP BY ALL",
    "p4_found": r"""
WITH t AS (SELECT row_id, regexp_extract_all(all_scenario_tags, '''(?:[^'']|'''')*''|"(?:[^"]|"")*"|[\p{L}\p{N}_]+') AS tags FROM scenario_sample),
u AS (SELECT row_id, unnest(range(1, len(tags) + 1)) AS position, unnest(tags) AS raw FROM t)
SELECT row_id, position, CASE WHEN raw[1] = '''' THEN replace(raw[2:-2], '''''', '''') WHEN raw[1] = '"' THEN replace(raw[2:-2], '""', '"') ELSE raw END AS tag FROM u""",
    "p7_found": f"""
WITH w AS (SELECT DISTINCT lower(trim(source_recording, {_WS})) AS r, window_start_us AS a, window_end_us AS z FROM scenario_sample
WHERE source_recording IS NOT NULL AND window_end_us > window_start_us),
m AS (SELECT *, max(z) OVER (PARTITION BY r ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT r, g, min(a) AS a, max(z) AS z FROM g GROUP BY r, g),
n AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM p)
SELECT r AS source_recording, 'period' AS kind, a AS start_us, z AS end_us FROM p
UNION ALL SELECT r, 'gap', a, z FROM n WHERE z - a <= {MAX_GAP_US}""",
}
QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month, "p4_found": p4_found, "p7_found": p7_found}
