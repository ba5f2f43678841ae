"""Matched outcomes: customers as units, order priorities as arms, capped mean order value as score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing as P
from ..sources.tables import table

ARMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CONTROL = "5-LOW"
SLUGS = [P.slug(a) for a in ARMS]
OTHERS = SLUGS[:-1]


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    return orders.groupBy("o_custkey", "o_orderpriority").agg(F.round(F.avg(F.least(F.col("o_totalprice") / 500000, F.lit(1.0))), 9).alias("score"))


def arm_labels(spark: SparkSession, d: str) -> DataFrame:
    out = P.labels(outcomes(spark, d), "o_custkey", "o_orderpriority", "score", ARMS, CONTROL)
    return out.select("o_custkey", *[f"score_{a}" for a in SLUGS], *[F.round(f"delta_{a}", 9).alias(f"delta_{a}") for a in OTHERS], "best_arm")


def _long_deltas(spark: SparkSession, d: str) -> DataFrame:
    return arm_labels(spark, d).unpivot("o_custkey", [f"delta_{a}" for a in OTHERS], "arm", "delta")


def arm_delta_summary(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("delta")
    agg = (F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_delta"), F.round(F.median(x), 6).alias("median_delta"), F.round(F.stddev_samp(x), 6).alias("std_delta"), F.round(F.avg((x > 0).cast("double")), 6).alias("share_positive"))
    return _long_deltas(spark, d).groupBy("arm").agg(*agg)


def pair_outcome_by_segment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    k = P.compare(F.col("delta"))
    counts = [F.count(F.when(k == v, 1)).alias(v) for v in ("better", "tie", "worse")]
    return _long_deltas(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "arm").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), *counts)


def incomplete_units(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with the arms it lacks, over the full unit x arm grid."""
    have = outcomes(spark, d)
    units = table(spark, d, "customer", F.col("c_custkey").alias("o_custkey"))
    arms = spark.createDataFrame([(a,) for a in ARMS], "o_orderpriority string")
    lacking = units.crossJoin(F.broadcast(arms)).join(have, ["o_custkey", "o_orderpriority"], "left_anti")
    return lacking.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), "|").alias("missing"), F.count("*").alias("n_missing"))


def score_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Product of gates times a weighted mean (weights 5, 5, 4, 2), per order, against the plain mean."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")
    gate = F.min(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0))
    parts = [F.avg(F.col("l_quantity") / 50), F.avg(1 - F.col("l_discount")), F.avg(1 - F.col("l_tax")), F.avg(F.least(F.col("l_extendedprice") / 100000, F.lit(1.0)))]
    weighted = (5 * parts[0] + 5 * parts[1] + 4 * parts[2] + 2 * parts[3]) / 16
    return li.groupBy("l_orderkey").agg(F.round(gate * weighted, 6).alias("score"), gate.alias("gate"))


def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share below 1 per metric and planner."""
    metrics = _METRICS.split(", ")
    long = table(spark, d, "planner_outcome", "planner", *metrics).unpivot("planner", metrics, "metric", "value")
    return long.groupBy("planner", "metric").agg(F.count("value").alias("n"), F.round(F.avg((F.col("value") < 1 - 1e-9).cast("double")), 6).alias("failure_rate"))


def policy_value_regret(spark: SparkSession, d: str) -> DataFrame:
    """A policy that predicts each delta by half the delta of the customer's first arm: choice, value, oracle, regret."""
    lab = arm_labels(spark, d)
    predicted = {a: F.col(f"delta_{OTHERS[0]}") / (i + 2) - 0.01 * i for i, a in enumerate(OTHERS)}
    chosen = lab.withColumn("choice", P.policy_choice(predicted, SLUGS[-1]))
    score = F.element_at(F.create_map(*[x for a in SLUGS for x in (F.lit(a), F.col(f"score_{a}"))]), F.col("choice"))
    top = F.greatest(*[F.col(f"score_{a}") for a in SLUGS])
    return chosen.agg(F.round(F.avg(score), 6).alias("policy_value"), F.round(F.avg(top), 6).alias("oracle_value"), F.round(F.avg(top - score), 6).alias("regret"), *[F.round(F.avg(f"score_{a}"), 6).alias(f"mean_{a}") for a in SLUGS])


_OUT = "o AS (SELECT o_custkey, o_orderpriority, round(avg(least(o_totalprice / 500000, 1.0)), 9) AS score FROM orders GROUP BY ALL)"
_WIDE = f"""{_OUT}, w AS (SELECT o_custkey, {", ".join(f"max(score) FILTER (o_orderpriority = '{a}') AS score_{s}" for a, s in zip(ARMS, SLUGS))} FROM o GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5),
l AS (SELECT *, {", ".join(f"round(score_{a} - score_{SLUGS[-1]}, 9) AS delta_{a}" for a in OTHERS)}, CASE {" ".join(f"WHEN score_{a} >= greatest({', '.join(f'score_{b}' for b in SLUGS)}) - 1e-9 THEN '{a}'" for a in SLUGS)} END AS best_arm FROM w),
u AS (UNPIVOT (SELECT o_custkey, {", ".join(f"delta_{a}" for a in OTHERS)} FROM l) ON {", ".join(f"delta_{a}" for a in OTHERS)} INTO NAME arm VALUE delta)"""
_METRICS = "no_ego_at_fault_collisions, drivable_area_compliance, ego_is_making_progress, driving_direction_compliance, ego_progress_along_expert_route, time_to_collision_within_bound, speed_limit_compliance, ego_is_comfortable"
_PRED = [f"(delta_{OTHERS[0]} / {i + 2} - {0.01 * i})" for i in range(len(OTHERS))]
SQL = {
    "arm_labels": f"WITH {_WIDE} SELECT * FROM l",
    "arm_delta_summary": f"WITH {_WIDE} SELECT arm, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(stddev_samp(delta), 6) AS std_delta, round(avg((delta > 0)::INT), 6) AS share_positive FROM u GROUP BY arm",
    "pair_outcome_by_segment": f"""WITH {_WIDE} SELECT c_mktsegment, arm, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 1e-9) AS better,
count(*) FILTER (abs(delta) <= 1e-9) AS tie, count(*) FILTER (delta < -1e-9) AS worse FROM u JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, arm""",
    "incomplete_units": f"""WITH {_OUT}, a AS (SELECT unnest({list(ARMS)}) AS p), g AS (SELECT c_custkey AS k, p FROM customer, a)
SELECT k AS o_custkey, string_agg(p, '|' ORDER BY p) AS missing, count(*) AS n_missing FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = k AND o_orderpriority = p) GROUP BY k""",
    "score_reconstruction": """SELECT l_orderkey, round(min(CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * (5 * avg(l_quantity / 50) + 5 * avg(1 - l_discount) + 4 * avg(1 - l_tax) + 2 * avg(least(l_extendedprice / 100000, 1.0))) / 16, 6) AS score,
min(CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS gate FROM lineitem GROUP BY l_orderkey""",
    "failure_rates": f"""WITH u AS (UNPIVOT (SELECT planner, {_METRICS} FROM planner_outcome) ON {_METRICS} INTO NAME metric VALUE v)
SELECT planner, metric, count(v) AS n, round(avg((v < 1 - 1e-9)::INT), 6) AS failure_rate FROM u GROUP BY ALL""",
    "policy_value_regret": f"""WITH {_WIDE}, p AS (SELECT *, greatest({", ".join(_PRED)}) AS top FROM l),
c AS (SELECT *, CASE WHEN top <= 0 THEN score_{SLUGS[-1]} {" ".join(f"WHEN {e} = top THEN score_{a}" for e, a in zip(_PRED, OTHERS))} END AS s, greatest({", ".join(f"score_{a}" for a in SLUGS)}) AS g FROM p)
SELECT round(avg(s), 6) AS policy_value, round(avg(g), 6) AS oracle_value, round(avg(g - s), 6) AS regret, {", ".join(f"round(avg(score_{a}), 6) AS mean_{a}" for a in SLUGS)} FROM c""",
}
QUERIES = {f.__name__: f for f in (arm_labels, arm_delta_summary, pair_outcome_by_segment, incomplete_units, score_reconstruction, failure_rates, policy_value_regret)}
