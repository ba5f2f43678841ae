"""Integration under a contract, coverage, duplicates, profiles, differences, cleaning and expectation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators.flags import typed
from ..quality import cleaning as C
from ..quality import expectations as E
from ..quality.contract import Contract, Field, integrate
from ..sources.tables import table

CONTRACT = Contract([Field("n_orders", "long", model_feature=True), Field("total", "double", model_feature=True), Field("region", "string", model_feature=True), Field("mean_line", "double", "outcome")], forbidden=("score", "delta"), keys=("c_custkey",))


OUTCOME_COLUMNS = [
    "outcome_id", "scenario_id", "log_name", "scenario_token", "scenario_type", "map_name", "anchor_timestamp_us", "window_start_us", "window_end_us", "score", "no_ego_at_fault_collisions", "drivable_area_compliance",
    "ego_is_making_progress", "driving_direction_compliance", "ego_progress_along_expert_route", "time_to_collision_within_bound", "speed_limit_compliance", "ego_is_comfortable", "succeeded", "error_message", "planner", "run_id", "recorded_at",
]


def feature_integration(spark: SparkSession, d: str) -> DataFrame:
    """Customers with three sources left-joined one to one, projected by the contract with _missing flags."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    orders = table(spark, d, "orders", "o_custkey", "o_totalprice")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    geo = c.join(table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("region"))
    return CONTRACT.project(integrate(c, {"orders": per, "geo": geo}, "c_custkey"))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Normalised run ids of outcomes that no run has, with their rows, per planner."""
    o = table(spark, d, "planner_outcome", "run_id", "planner").select(norm_key("run_id").alias("run"), "planner").where("run is not null")
    r = table(spark, d, "run_result", "run_id").select(norm_key("run_id").alias("run")).distinct()
    return o.join(r, "run", "left_anti").groupBy("planner").agg(F.countDistinct("run").alias("n_runs"), F.count("*").alias("n_rows"))


def duplicate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return C.duplicate_kinds(li, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Groups of byte-equal texts: class, members, first id."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    g = t.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.where("n > 1")


def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.null_profile(table(spark, d, "planner_outcome"), OUTCOME_COLUMNS)


def table_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    other = o.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return C.table_diff(o, other, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


def cleaning_steps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "planner_outcome", "outcome_id", "scenario_id", "run_id", "score", "succeeded").withColumn("run_id", norm_key("run_id"))
    runs = table(spark, d, "run_result", "run_id").select(norm_key("run_id").alias("run_id"))
    log = C.CleaningLog(o).drop("no scenario", F.col("scenario_id").isNull()).null_out("score of failed", "score", ~F.col("succeeded")).null_out("score out of range", "score", ~F.col("score").between(0, 0.95)).keep_known("unknown run", runs, "run_id")
    return log.log()


def _broken() -> DataFrame:
    raise ValueError("a check that can't be built")


def _breaks(df: DataFrame) -> DataFrame:
    """A check that is built but fails while it runs."""
    return E.holds(df, "breaks", F.assert_true(F.col("o_orderkey") < 0).isNull())


def expectation_report(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, d, "customer", F.col("c_custkey").alias("o_custkey"))
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    checks = [
        ("orders unique", lambda: E.unique(o, "orders unique", ["o_orderkey"])),
        ("lines unique", lambda: E.unique(li, "lines unique", ["l_orderkey", "l_linenumber"])),
        ("orders complete", lambda: E.not_null(o, "orders complete", ["o_orderkey", "o_custkey"])),
        ("price positive", lambda: E.holds(o, "price positive", F.col("o_totalprice") > 1000)),
        ("discount range", lambda: E.in_range(li, "discount range", "l_discount", 0.0, 0.05)),
        ("flag domain", lambda: E.in_domain(li, "flag domain", "l_returnflag", ["A", "N"])),
        ("customers known", lambda: E.covered(o, "customers known", c, ["o_custkey"])),
        ("broken", _broken),
        ("breaks", lambda: _breaks(o)),
    ]
    return E.report(checks, spark).select("position", "check", "status", "violations")


def typed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Parsing text to numbers: blank and invalid give null, counted apart."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand").withColumn("raw", F.regexp_replace("p_brand", "Brand#", ""))
    raw = F.when(F.col("p_partkey") % 7 == 0, " ").when(F.col("p_partkey") % 11 == 0, "x1").otherwise(F.col("raw"))
    v = typed(raw, "int")
    return p.agg(F.count("*").alias("n"), F.count(v).alias("n_valid"), F.count(F.when((F.btrim(raw) != "") & v.isNull(), 1)).alias("n_invalid"), F.sum(v).cast("long").alias("total"))


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_RAW = "CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN 'x1' ELSE replace(p_brand, 'Brand#', '') END"
SQL = {
    "feature_integration": """WITH p AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1)
SELECT c_custkey, n AS n_orders, n IS NULL AS n_orders_missing, t AS total, t IS NULL AS total_missing, r_name AS region, r_name IS NULL AS region_missing
FROM customer LEFT JOIN p ON k = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "coverage_gaps": f"""WITH o AS (SELECT lower(trim(run_id, {_WS})) AS run, planner FROM planner_outcome WHERE run_id IS NOT NULL)
SELECT planner, count(DISTINCT run) AS n_runs, count(*) AS n_rows FROM o WHERE NOT EXISTS (SELECT 1 FROM run_result WHERE lower(trim(run_id, {_WS})) = run) GROUP BY 1""",
    "duplicate_conflicts": "SELECT l_orderkey, l_linenumber, count(*) AS copies, CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) = 1 THEN 'exact' ELSE 'conflict' END AS kind FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "exact_copies": "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows FROM planner_outcome" for c in OUTCOME_COLUMNS),
    "table_diff": "WITH o AS (SELECT o_orderkey % 17 <> 0 AS b, o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0 AS p FROM orders) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({f}) AS agree, count(*) FILTER (NOT {f}) AS differ, count(*) AS total FROM o" for c, f in (("o_custkey", "b"), ("o_orderstatus", "b"), ("o_totalprice", "p"))),
    "cleaning_steps": f"""WITH o AS (SELECT lower(trim(run_id, {_WS})) AS run, score, succeeded FROM planner_outcome WHERE scenario_id IS NOT NULL)
SELECT 0 AS position, 'no scenario' AS step, count(*) AS affected FROM planner_outcome WHERE scenario_id IS NULL UNION ALL SELECT 1, 'score of failed', count(*) FROM o WHERE NOT succeeded
UNION ALL SELECT 2, 'score out of range', count(*) FROM o WHERE coalesce(succeeded, true) AND NOT score BETWEEN 0 AND 0.95
UNION ALL SELECT 3, 'unknown run', count(*) FROM o WHERE run IS NULL OR NOT EXISTS (SELECT 1 FROM run_result WHERE lower(trim(run_id, {_WS})) = run)""",
    "expectation_report": """WITH v AS (SELECT 0 AS position, 'orders unique' AS "check", (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations
UNION ALL SELECT 1, 'lines unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 2, 'orders complete', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL OR o_custkey IS NULL)
UNION ALL SELECT 3, 'price positive', (SELECT count(*) FROM orders WHERE NOT coalesce(o_totalprice > 1000, false))
UNION ALL SELECT 4, 'discount range', (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05)
UNION ALL SELECT 5, 'flag domain', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
UNION ALL SELECT 6, 'customers known', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 7, 'broken', 1 UNION ALL SELECT 8, 'breaks', 1)
SELECT position, "check", CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status, violations FROM v""",
    "typed_parse": f"WITH r AS (SELECT {_RAW} AS raw FROM part), v AS (SELECT raw, try_cast(nullif(trim(raw), '') AS INT) AS v FROM r) SELECT count(*) AS n, count(v) AS n_valid, count(*) FILTER (trim(raw) <> '' AND v IS NULL) AS n_invalid, sum(v)::BIGINT AS total FROM v",
}
QUERIES = {f.__name__: f for f in (feature_integration, coverage_gaps, duplicate_conflicts, exact_copies, null_profile, table_diff, cleaning_steps, expectation_report, typed_parse)}
