"""Descriptions of the outcome and scenario tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_category, norm_key
from ..operators import describe as D
from ..sources.tables import micros, table
from .problems import _WS

# The score components of an outcome.
COMPONENTS = (
    "no_ego_at_fault_collisions", "drivable_area_compliance", "ego_is_making_progress", "driving_direction_compliance",
    "ego_progress_along_expert_route", "time_to_collision_within_bound", "speed_limit_compliance", "ego_is_comfortable",
)
CONTROL, CANDIDATE = "rulebook", "gap_keeper"


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.value_counts(table(spark, d, "planner_outcome", "planner", "scenario_type", "map_name", "succeeded"), ["planner", "scenario_type", "map_name", "succeeded"])


def pose_extents(spark: SparkSession, d: str) -> DataFrame:
    return D.extents(table(spark, d, "ego_pose", "pose_id", "timestamp_us"), ["pose_id", "timestamp_us"])


def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return D.percentiles(table(spark, d, "planner_outcome", "planner", "score"), ["planner"], "score", (0.05, 0.25, 0.5, 0.75, 0.95))


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("score")
    return D.distribution(table(spark, d, "planner_outcome", "planner", "score"), ["planner"], "score", {"share_zero": x == 0, "share_perfect": x >= 1 - 1e-9, "share_below_half": x < 0.5})


def city_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per city: window lengths, distinct hours and days of the anchors, rows deleted, rows delivered late."""
    s = table(spark, d, "scenario_sample", "source_city", "anchor_timestamp_us", "window_start_us", "window_end_us", "ingested_at", "deleted_at")
    size, at = F.col("window_end_us") - F.col("window_start_us"), F.col("anchor_timestamp_us")
    return s.groupBy(norm_category("source_city").alias("city")).agg(
        F.count("*").alias("n"), F.min(size).alias("shortest"), F.round(F.median(size), 1).alias("median"), F.max(size).alias("longest"),
        F.countDistinct(F.expr("anchor_timestamp_us div 3600000000")).alias("hours"), F.countDistinct(F.expr("anchor_timestamp_us div 86400000000")).alias("days"),
        F.count(F.when(F.col("deleted_at").isNotNull(), 1)).alias("deleted"), F.count(F.when(micros("ingested_at") - at > 86_400_000_000 * 365, 1)).alias("late"),
    )


def outcome_crosstab(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("succeeded"), "succeeded").when(~F.col("succeeded"), "failed").otherwise("unknown")
    return D.crosstab(table(spark, d, "planner_outcome", "planner", "succeeded").withColumn("status", status), "planner", "status", ["failed", "succeeded", "unknown"])


def score_loss_parts(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the scores below 1, split by the first gate that fails."""
    o = table(spark, d, "planner_outcome", "score", *COMPONENTS).where("score is not null").withColumn("loss", 1 - F.col("score"))
    return D.decompose(o, "loss", {"collision": F.col(COMPONENTS[0]) < 1, "off the road": F.col(COMPONENTS[1]) <= 0, "no progress": F.col(COMPONENTS[2]) <= 0, "wrong direction": F.col(COMPONENTS[3]) <= 0}, rest="driving quality")


def type_variance(spark: SparkSession, d: str) -> DataFrame:
    return D.variance_within(table(spark, d, "planner_outcome", "scenario_type", "score").withColumn("t", norm_category("scenario_type")), ["t"], "score")


def city_anchor_shares(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scenario_sample", "source_city", "anchor_timestamp_us", "window_start_us").withColumn("city", norm_category("source_city"))
    return D.shares_over(s, "city", F.col("window_start_us") == F.col("anchor_timestamp_us") - 3_000_000, 0.96)


def log_first_pose(spark: SparkSession, d: str) -> DataFrame:
    """The first reading of every log, by pose_id."""
    p = table(spark, d, "ego_pose", "pose_id", "log_name", "x", "y").where("log_name is not null").withColumn("log", norm_key("log_name"))
    return D.first_per(p, ["log"], ["pose_id"], ["pose_id", "x", "y"])


def city_points(spark: SparkSession, d: str) -> DataFrame:
    """Per city the median, least and greatest first reading of its logs, and the span of the diagonal in km."""
    s = table(spark, d, "scenario_sample", "log_name", "source_city").select(norm_key("log_name").alias("log"), norm_category("source_city").alias("city")).where("log is not null and city is not null")
    j = log_first_pose(spark, d).join(s.groupBy("log").agg(F.min("city").alias("city")), "log")
    low, high = [F.min(c) for c in "xy"], [F.max(c) for c in "xy"]
    span = F.sqrt((high[0] - low[0]) * (high[0] - low[0]) + (high[1] - low[1]) * (high[1] - low[1])) / 1000
    return j.groupBy("city").agg(F.count("*").alias("n_logs"), F.round(F.median("x"), 3).alias("x"), F.round(F.median("y"), 3).alias("y"), F.round(span, 6).alias("span_km"))


def log_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Per log the first file named for it and its tokens, sorted and distinct."""
    s = table(spark, d, "scenario_sample", "row_id", "log_name", "db_file", "scenario_token").where("log_name is not null").withColumn("log", norm_key("log_name"))
    return s.groupBy("log").agg(F.min_by("db_file", F.when(F.col("db_file").isNotNull(), F.col("row_id"))).alias("db_file"), F.array_join(F.array_sort(F.collect_set(F.lower("scenario_token"))), "|").alias("tokens"))


def score_cdf(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "planner_outcome", "outcome_id", "planner", "score")
    return D.cumulative_share(o, ["planner"], "score", "outcome_id").select("outcome_id", "planner", F.round("cdf", 9).alias("cdf"))


def latest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One row per scenario and planner: the last one recorded (then the greatest id) of those that have a score."""
    o = table(spark, d, "planner_outcome", "outcome_id", "scenario_id", "planner", "scenario_type", "score", "recorded_at", *COMPONENTS).where("scenario_id is not null and score is not null")
    o = o.withColumn("scenario", norm_key("scenario_id"))
    v = ["outcome_id", "scenario_type", "score", *COMPONENTS]
    return o.groupBy("scenario", "planner").agg(F.max_by(F.struct(*v), F.struct(micros("recorded_at"), "outcome_id")).alias("v")).select("scenario", "planner", "v.*")


def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios with both arms, side by side: every metric of either arm, the delta, the outcome and the gates."""
    o = latest_outcomes(spark, d).where(F.col("planner").isin(CONTROL, CANDIDATE))
    m = ["score", *COMPONENTS]
    wide = o.groupBy("scenario").pivot("planner", [CONTROL, CANDIDATE]).agg(*[F.first(c).alias(c) for c in m])
    wide = wide.select("scenario", *[F.col(f"{p}_{c}").alias(f"{c}_{a}") for p, a in ((CONTROL, "control"), (CANDIDATE, "candidate")) for c in m]).where("score_control is not null and score_candidate is not null")
    delta = F.round(F.col("score_candidate") - F.col("score_control"), 9)
    gate = lambda a: F.least(*[F.col(f"{c}_{a}") for c in COMPONENTS[:4]]) <= 0
    return wide.withColumn("delta", delta).withColumn("outcome", F.when(delta > 1e-9, "better").when(delta < -1e-9, "worse").otherwise("tie")).withColumn("gated_control", gate("control")).withColumn("gated_candidate", gate("candidate"))


def pair_changes(spark: SparkSession, d: str) -> DataFrame:
    p = matched_pairs(spark, d)
    text = D.changed(COMPONENTS, {c: f"{c}_control" for c in COMPONENTS}, {c: f"{c}_candidate" for c in COMPONENTS})
    return p.select("scenario", text.alias("changes"))


def largest_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The twelve pairs of the largest absolute delta, ties by scenario."""
    return D.top(matched_pairs(spark, d).select("scenario", "delta"), 12, F.abs("delta").desc(), F.col("scenario"))


_OUT = f"""o AS (SELECT *, lower(trim(scenario_id, {_WS})) AS scenario, row_number() OVER (PARTITION BY lower(trim(scenario_id, {_WS})), planner ORDER BY recorded_at DESC NULLS LAST, outcome_id DESC) AS nth
FROM planner_outcome WHERE scenario_id IS NOT NULL AND score IS NOT NULL), l AS (SELECT * FROM o WHERE nth = 1)"""
_M = ("score", *COMPONENTS)
_PAIR = f"""{_OUT}, w AS (SELECT a.scenario, {", ".join(f"a.{c} AS {c}_control" for c in _M)}, {", ".join(f"b.{c} AS {c}_candidate" for c in _M)}, round(b.score - a.score, 9) AS delta
FROM l AS a JOIN l AS b ON a.scenario = b.scenario AND a.planner = '{CONTROL}' AND b.planner = '{CANDIDATE}'),
p AS (SELECT *, CASE WHEN delta > 1e-9 THEN 'better' WHEN delta < -1e-9 THEN 'worse' ELSE 'tie' END AS outcome, {", ".join(f"least({', '.join(f'{c}_{a}' for c in COMPONENTS[:4])}) <= 0 AS gated_{a}" for a in ("control", "candidate"))} FROM w)"""
_CAT = "nullif(translate(lower(trim({c}, " + _WS + ")), ' -', '__'), '')"
_CITY = _CAT.format(c="source_city")
_FIRST = f"f AS (SELECT lower(trim(log_name, {_WS})) AS log, min(pose_id) AS pose_id, arg_min(x, pose_id) AS x, arg_min(y, pose_id) AS y FROM (SELECT * REPLACE (coalesce(x, 'nan'::DOUBLE) AS x, coalesce(y, 'nan'::DOUBLE) AS y) FROM ego_pose) WHERE log_name IS NOT NULL GROUP BY 1)"
SQL = {
    "outcome_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce({c}::VARCHAR, 'null') AS value, count(*) AS n FROM planner_outcome GROUP BY 2" for c in ("planner", "scenario_type", "map_name", "succeeded")),
    "pose_extents": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high, count({c}) AS n FROM ego_pose" for c in ("pose_id", "timestamp_us")),
    "score_percentiles": "SELECT planner, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS low, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(max(score), 6) AS high FROM planner_outcome GROUP BY 1",
    "score_distribution": "SELECT planner, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std, round(avg((score = 0)::INT), 6) AS share_zero, round(avg((score >= 1 - 1e-9)::INT), 6) AS share_perfect, round(avg((score < 0.5)::INT), 6) AS share_below_half FROM planner_outcome GROUP BY 1",
    "city_profile": f"""SELECT {_CITY} AS city, count(*) AS n, min(window_end_us - window_start_us) AS shortest, round(median(window_end_us - window_start_us), 1) AS median, max(window_end_us - window_start_us) AS longest,
count(DISTINCT anchor_timestamp_us // 3600000000) AS hours, count(DISTINCT anchor_timestamp_us // 86400000000) AS days, count(deleted_at) AS deleted, count(*) FILTER (epoch_us(ingested_at) - anchor_timestamp_us > {86_400_000_000 * 365}) AS late FROM scenario_sample GROUP BY 1""",
    "outcome_crosstab": "SELECT planner, count(*) FILTER (NOT succeeded) AS failed, count(*) FILTER (succeeded) AS succeeded, count(*) FILTER (succeeded IS NULL) AS unknown FROM planner_outcome GROUP BY 1",
    "score_loss_parts": f"""WITH o AS (SELECT 1 - score AS loss, CASE WHEN {COMPONENTS[0]} < 1 THEN 'collision' WHEN {COMPONENTS[1]} <= 0 THEN 'off the road' WHEN {COMPONENTS[2]} <= 0 THEN 'no progress' WHEN {COMPONENTS[3]} <= 0 THEN 'wrong direction' ELSE 'driving quality' END AS part FROM planner_outcome WHERE score IS NOT NULL)
SELECT part, count(*) AS n, round(sum(loss), 6) AS total, round(sum(loss) / (SELECT sum(loss) FROM o), 6) AS share FROM o GROUP BY part""",
    "type_variance": f"""WITH g AS (SELECT {_CAT.format(c="scenario_type")} AS t, score FROM planner_outcome WHERE score IS NOT NULL), k AS (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM g),
v AS (SELECT t, var_pop(score) AS v FROM k WHERE c >= 2 GROUP BY t) SELECT (SELECT count(*) FROM v) AS n_groups, count(*) AS n, (SELECT round(avg(v), 6) FROM v) AS within, round(var_pop(score), 6) AS overall FROM k WHERE c >= 2""",
    "city_anchor_shares": f"""WITH g AS (SELECT {_CITY} AS city, count(*) AS n, count(*) FILTER (window_start_us = anchor_timestamp_us - 3000000) AS hits FROM scenario_sample GROUP BY 1)
SELECT city, n, hits, round(hits / n, 6) AS share, hits / n >= 0.96 AS ok FROM g""",
    "log_first_pose": f"WITH {_FIRST} SELECT log, pose_id, nullif(x, 'nan'::DOUBLE) AS x, nullif(y, 'nan'::DOUBLE) AS y FROM f",
    "city_points": f"""WITH {_FIRST}, c AS (SELECT lower(trim(log_name, {_WS})) AS log, min({_CITY}) AS city FROM scenario_sample WHERE log_name IS NOT NULL AND {_CITY} IS NOT NULL GROUP BY 1),
j AS (SELECT city, nullif(x, 'nan'::DOUBLE) AS x, nullif(y, 'nan'::DOUBLE) AS y FROM f JOIN c USING (log))
SELECT city, count(*) AS n_logs, round(median(x), 3) AS x, round(median(y), 3) AS y, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 1000, 6) AS span_km FROM j GROUP BY 1""",
    "log_tasks": f"SELECT lower(trim(log_name, {_WS})) AS log, arg_min(db_file, row_id) FILTER (db_file IS NOT NULL) AS db_file, coalesce(string_agg(DISTINCT lower(scenario_token), '|' ORDER BY lower(scenario_token)), '') AS tokens FROM scenario_sample WHERE log_name IS NOT NULL GROUP BY 1",
    "score_cdf": "SELECT outcome_id, planner, round(row_number() OVER (PARTITION BY planner ORDER BY score, outcome_id) / count(*) OVER (PARTITION BY planner), 9) AS cdf FROM planner_outcome WHERE score IS NOT NULL",
    "latest_outcomes": f"WITH {_OUT} SELECT scenario, planner, outcome_id, scenario_type, score, {', '.join(COMPONENTS)} FROM l",
    "matched_pairs": f"WITH {_PAIR} SELECT * FROM p",
    "pair_changes": f"""WITH {_PAIR}, u AS ({" UNION ALL ".join(f"SELECT scenario, '{c}' AS name, {c}_candidate - {c}_control AS diff FROM p" for c in COMPONENTS)})
SELECT scenario, coalesce(string_agg(name || ' ' || printf('%+.4f', diff), '; ' ORDER BY abs(diff) DESC, name) FILTER (abs(diff) > 0.01), '') AS changes FROM u GROUP BY scenario""",
    "largest_deltas": f"WITH {_PAIR} SELECT scenario, delta FROM p ORDER BY abs(delta) DESC, scenario LIMIT 12",
}
QUERIES = {f.__name__: f for f in (outcome_counts, pose_extents, score_percentiles, score_distribution, city_profile, outcome_crosstab, score_loss_parts, type_variance, city_anchor_shares, log_first_pose, city_points, log_tasks, score_cdf, latest_outcomes, matched_pairs, pair_changes, largest_deltas)}
