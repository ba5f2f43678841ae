"""Label and modeling tables out of outcomes and scenarios, and the validation of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_category, norm_key
from ..operators import assembly as A
from ..operators import pairing as P
from ..operators import sampling as S
from ..quality import policy
from ..quality.contract import Contract, Field
from ..sources.tables import micros, table
from .describe import _CAT, _CITY, _OUT, latest_outcomes
from .problems import _WS

PLANNERS = ("rulebook", "gap_keeper", "rail_spline", "branch_search")
CITIES = {"dunmere": "north", "port_calder": "coast", "oru_bay": "coast"}
OUTCOMES = Contract(
    [
        Field("scenario_id", "string", "metadata", missing="fail_validation"), Field("run_id", "string", "provenance", missing="exclude_pair"), Field("score", "double", "outcome", missing="exclude_pair"),
        Field("error_message", "string", "outcome", missing="not_applicable_when_succeeded"), Field("map_name", "string", "covariate", missing="null_with_indicator"), Field("planner", "string", "treatment", missing="constant_from_metadata"),
    ]
)


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    """One row per scenario: its first delivery (by time, then row_id)."""
    cols = ["row_id", "log_name", "db_file", "scenario_token", "anchor_timestamp_us", "scenario_type", "map_name", "source_recording", "source_city"]
    s = table(spark, d, "scenario_sample", "scenario_id", "ingested_at", *cols).where("scenario_id is not null").withColumn("scenario", norm_key("scenario_id"))
    s = s.groupBy("scenario").agg(F.min_by(F.struct(*cols), F.struct(F.coalesce(micros("ingested_at"), F.lit(2**62)), "row_id")).alias("v")).select("scenario", "v.*")
    return s.withColumn("log", norm_key("log_name")).withColumn("token", norm_key("scenario_token")).withColumn("city", norm_category("source_city")).withColumn("kind", norm_category("scenario_type"))


def scenario_keys(spark: SparkSession, d: str) -> DataFrame:
    """The id made of its parts, and whether the given one agrees."""
    s = table(spark, d, "scenario_sample", "row_id", "scenario_id", "log_name", "scenario_token")
    made = F.when(F.col("log_name").isNotNull() & F.col("scenario_token").isNotNull(), F.concat_ws(":", norm_key("log_name"), norm_key("scenario_token")))
    return s.select("row_id", made.alias("made_id"), norm_key("scenario_id").eqNullSafe(made).alias("agrees"))


def outcome_failures(spark: SparkSession, d: str) -> DataFrame:
    """Per scenario and planner why outcomes can't be used."""
    o = table(spark, d, "planner_outcome", "scenario_id", "planner", "run_id", "succeeded", "score").where("scenario_id is not null").withColumn("scenario", norm_key("scenario_id"))
    rules = {"simulation failed": ~F.col("succeeded"), "no score": F.col("score").isNull(), "score out of range": ~F.col("score").between(0, 0.95), "no run": F.col("run_id").isNull()}
    return A.reasons(o, ["scenario", "planner"], rules)


def planner_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios with all arms: scores, deltas against the control, the best arm."""
    lab = P.labels(latest_outcomes(spark, d), "scenario", "planner", "score", PLANNERS, PLANNERS[0])
    return lab.select(*[F.round(c, 9).alias(c) if c.startswith("delta") else F.col(c) for c in lab.columns])


def modeling_table(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the scenario's features, region and fold; logs never stand in two folds."""
    lab = planner_labels(spark, d).select("scenario", "best_arm")
    s = scenarios(spark, d).where("log is not null").select("scenario", "log", "city", "kind")
    rows = A.join_one_to_one(lab, s, ["scenario"])
    folds = S.balanced_folds(rows, "log", "scenario", folds=5, seed=11).select("log", "fold")
    region = A.mapped(F.col("city"), CITIES)
    return A.join_many_to_one(rows, folds, ["log"]).select("scenario", "log", region.alias("region"), "kind", "best_arm", "fold")


def modeling_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios with outcomes that no delivery knows: how many, and the first five."""
    o = table(spark, d, "planner_outcome", "scenario_id").select(norm_key("scenario_id").alias("scenario"))
    return A.coverage(o, scenarios(spark, d), "scenario")


def identity_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes against the first delivery of their scenario: columns that should say the same."""
    o = table(spark, d, "planner_outcome", "scenario_id", "log_name", "scenario_token", "scenario_type", "map_name", "anchor_timestamp_us").withColumn("scenario", norm_key("scenario_id"))
    o = o.withColumn("log", norm_key("log_name")).withColumn("token", norm_key("scenario_token")).withColumn("kind", norm_category("scenario_type"))
    return A.mismatches(o, scenarios(spark, d), "scenario", ["log", "token", "kind", "map_name", "anchor_timestamp_us"])


def delivery_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """First and last delivery of every scenario: every value that changed."""
    s = table(spark, d, "scenario_sample", "row_id", "scenario_id", "scenario_type", "map_name", "source_city", "ingested_at").where("scenario_id is not null").withColumn("scenario", norm_key("scenario_id"))
    at, v = F.struct(F.coalesce(micros("ingested_at"), F.lit(2**62)), "row_id"), F.struct("scenario_type", "map_name", "source_city")
    g = s.groupBy("scenario").agg(F.min_by(v, at).alias("a"), F.max_by(v, at).alias("b"))
    return A.disagreements(g.select("scenario", "a.*"), g.select("scenario", "b.*"), "scenario", ["scenario_type", "map_name", "source_city"])


def missing_policies(spark: SparkSession, d: str) -> DataFrame:
    return policy.summary(table(spark, d, "planner_outcome"), OUTCOMES, succeeded="succeeded")


def policy_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the policies leave, per planner."""
    o = table(spark, d, "planner_outcome", *[f.name for f in OUTCOMES.fields], "succeeded").where("scenario_id is not null")
    out = policy.apply(o, OUTCOMES, succeeded="succeeded", constants={"planner": "unnamed"})
    return out.groupBy("planner").agg(F.count("*").alias("n"), F.count(F.when(F.col("map_name_missing"), 1)).alias("n_map_missing"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run: the last report of it."""
    r = table(spark, d, "run_result", "result_id", "run_id", "planner", "requested", "executed", "scored", "failed", "official_score", "finished_at").where("run_id is not null").withColumn("run", norm_key("run_id"))
    v = F.struct("result_id", "planner", "requested", "executed", "scored", "failed", "official_score")
    return r.groupBy("run").agg(F.max_by(v, F.struct(F.coalesce(micros("finished_at"), F.lit(-(2**62))), "result_id")).alias("v")).select("run", "v.*")


def run_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every reported run against its outcomes: membership, repeats, planners, range of scores, mean against the official one."""
    o = table(spark, d, "planner_outcome", "run_id", "scenario_id", "planner", "succeeded", "score").where("run_id is not null").withColumn("run", norm_key("run_id")).withColumn("scenario", norm_key("scenario_id"))
    per = o.groupBy("run").agg(
        F.count("*").alias("n_rows"), F.countDistinct("scenario").alias("n_scenarios"), F.countDistinct("planner").alias("n_planners"), F.min("planner").alias("one_planner"),
        F.count(F.when(~F.col("score").between(0, 1), 1)).alias("n_bad"), F.count("score").alias("n_scored"), F.avg("score").alias("mean"),
    )
    j = A.join_one_to_one(_runs(spark, d), per, ["run"])
    status = A.first_match(
        [
            (F.col("n_planners") != 1, "several planners"), (F.col("one_planner") != F.col("planner"), "other planner"), (F.col("n_bad") > 0, "bad score"), (F.col("n_rows") != F.col("n_scenarios"), "repeated scenario"),
            (F.col("n_scored") != F.col("scored"), "other number of scores"), (F.coalesce(F.abs(F.col("mean") - F.col("official_score")) > 1e-3, F.lit(True)), "other mean"),
        ],
        "ok",
    )
    return j.select("run", "n_rows", "n_scenarios", "n_scored", status.alias("status"))


def run_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Per planner whether its runs can be compared: one name in the ids, the same requests, reports in one place."""
    r = table(spark, d, "run_result", "run_id", "planner", "requested", "runner_report").where("run_id is not null")
    name = norm_key(F.regexp_extract("run_id", r"^\s*(.*)_sweep_", 1))
    place = F.regexp_extract("runner_report", "^([^/]*)/", 1)
    g = r.groupBy("planner").agg(F.countDistinct(norm_key("run_id")).alias("n_runs"), F.countDistinct(name).alias("n_names"), F.count(F.when(name != F.col("planner"), 1)).alias("n_other_name"), F.countDistinct("requested").alias("n_requests"), F.countDistinct(place).alias("n_places"))
    return g.withColumn("compatible", (F.col("n_names") == 1) & (F.col("n_other_name") == 0) & (F.col("n_places") == 1))


_SCEN = f"""s AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(scenario_id, {_WS})) ORDER BY coalesce(epoch_us(ingested_at), 4611686018427387904), row_id) AS nth,
row_number() OVER (PARTITION BY lower(trim(scenario_id, {_WS})) ORDER BY coalesce(epoch_us(ingested_at), 4611686018427387904) DESC, row_id DESC) AS back FROM scenario_sample WHERE scenario_id IS NOT NULL),
c AS (SELECT *, lower(trim(scenario_id, {_WS})) AS scenario, lower(trim(log_name, {_WS})) AS log, lower(trim(scenario_token, {_WS})) AS token, {_CITY} AS city, {_CAT.format(c="scenario_type")} AS kind FROM s WHERE nth = 1)"""
_SLUGS = [P.slug(p) for p in PLANNERS]
_LAB = f"""{_OUT}, w AS (SELECT scenario, {", ".join(f"max(score) FILTER (planner = '{p}') AS score_{s}" for p, s in zip(PLANNERS, _SLUGS))} FROM l GROUP BY scenario),
lab AS (SELECT *, {", ".join(f"round(score_{s} - score_{_SLUGS[0]}, 9) AS delta_{s}" for s in _SLUGS[1:])}, CASE {" ".join(f"WHEN score_{s} >= greatest({', '.join(f'score_{x}' for x in _SLUGS)}) - 1e-9 THEN '{s}'" for s in _SLUGS)} END AS best_arm
FROM w WHERE {" AND ".join(f"score_{s} IS NOT NULL" for s in _SLUGS)})"""
_RUN = f"""r AS (SELECT *, lower(trim(run_id, {_WS})) AS run, row_number() OVER (PARTITION BY lower(trim(run_id, {_WS})) ORDER BY coalesce(epoch_us(finished_at), -4611686018427387904) DESC, result_id DESC) AS nth FROM run_result WHERE run_id IS NOT NULL)"""
SQL = {
    "scenario_keys": f"""WITH k AS (SELECT row_id, lower(trim(scenario_id, {_WS})) AS k, lower(trim(log_name, {_WS})) || ':' || lower(trim(scenario_token, {_WS})) AS m FROM scenario_sample) SELECT row_id, m AS made_id, k IS NOT DISTINCT FROM m AS agrees FROM k""",
    "outcome_failures": f"""WITH o AS (SELECT lower(trim(scenario_id, {_WS})) AS scenario, planner, count(*) AS n, bool_or(coalesce(NOT succeeded, false)) AS a, bool_or(score IS NULL) AS b, bool_or(coalesce(NOT score BETWEEN 0 AND 0.95, false)) AS c, bool_or(run_id IS NULL) AS d
FROM planner_outcome WHERE scenario_id IS NOT NULL GROUP BY ALL), t AS (SELECT scenario, planner, n, concat_ws('; ', CASE WHEN a THEN 'simulation failed' END, CASE WHEN b THEN 'no score' END, CASE WHEN c THEN 'score out of range' END, CASE WHEN d THEN 'no run' END) AS reasons FROM o)
SELECT * FROM t WHERE reasons <> ''""",
    "planner_labels": f"WITH {_LAB} SELECT * FROM lab",
    "modeling_table": f"""WITH RECURSIVE {_LAB}, {_SCEN}, m AS (SELECT lab.scenario, log, city, kind, best_arm FROM lab JOIN c ON c.scenario = lab.scenario WHERE log IS NOT NULL),
z AS (SELECT log, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, sha256('11:' || log)[:16], log) AS i FROM m GROUP BY log),
f(i, log, fold, load) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::INT, [0, 0, 0, 0, 0]::BIGINT[]
UNION ALL SELECT z.i, z.log, (list_position(load, list_min(load)) - 1)::INT, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN z.size ELSE 0 END) FROM f JOIN z ON z.i = f.i + 1)
SELECT scenario, m.log, CASE WHEN city IS NULL THEN 'null' WHEN city = 'dunmere' THEN 'north' WHEN city IN ('port_calder', 'oru_bay') THEN 'coast' ELSE 'unmapped' END AS region, kind, best_arm, fold FROM m LEFT JOIN f ON f.log = m.log""",
    "modeling_coverage": f"""WITH {_SCEN}, k AS (SELECT DISTINCT lower(trim(scenario_id, {_WS})) AS k FROM planner_outcome WHERE scenario_id IS NOT NULL), a AS (SELECT k FROM k WHERE k NOT IN (SELECT scenario FROM c))
SELECT (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM a) AS n_absent, (SELECT string_agg(k, '|' ORDER BY k) FROM (SELECT k FROM a ORDER BY k LIMIT 5)) AS sample""",
    "identity_mismatches": f"""WITH {_SCEN}, o AS (SELECT lower(trim(scenario_id, {_WS})) AS scenario, lower(trim(log_name, {_WS})) AS log, lower(trim(scenario_token, {_WS})) AS token, {_CAT.format(c="scenario_type")} AS kind, map_name, anchor_timestamp_us FROM planner_outcome),
"""
    + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) AS n_compared, count(*) FILTER (o.{x} IS DISTINCT FROM c.{x}) AS n_mismatch FROM o JOIN c ON c.scenario = o.scenario" for x in ("log", "token", "kind", "map_name", "anchor_timestamp_us")).replace("SELECT", "j AS (SELECT 1) SELECT", 1),
    "delivery_disagreements": f"""WITH {_SCEN}, p AS (SELECT c.scenario, {", ".join(f"c.{x} AS a_{x}, b.{x} AS b_{x}" for x in ("scenario_type", "map_name", "source_city"))} FROM c JOIN s AS b ON lower(trim(b.scenario_id, {_WS})) = c.scenario AND b.back = 1),
u AS ({" UNION ALL ".join(f"SELECT scenario, '{x}' AS c, a_{x} AS a, b_{x} AS b FROM p" for x in ("scenario_type", "map_name", "source_city"))}) SELECT scenario, c AS "column", a AS "left", b AS "right" FROM u WHERE a IS DISTINCT FROM b""",
    "missing_policies": " UNION ALL ".join(f"SELECT '{f.name}' AS \"column\", '{f.missing}' AS policy, count(*) FILTER ({f.name} IS NULL{' AND NOT coalesce(succeeded, false)' if f.missing == 'not_applicable_when_succeeded' else ''}) AS n_missing, count(*) AS n_rows FROM planner_outcome" for f in OUTCOMES.fields),
    "policy_rows": "SELECT coalesce(planner, 'unnamed') AS planner, count(*) AS n, count(*) FILTER (map_name IS NULL) AS n_map_missing FROM planner_outcome WHERE scenario_id IS NOT NULL AND run_id IS NOT NULL AND score IS NOT NULL GROUP BY 1",
    "run_validation": f"""WITH {_RUN}, p AS (SELECT lower(trim(run_id, {_WS})) AS run, count(*) AS n_rows, count(DISTINCT lower(trim(scenario_id, {_WS}))) AS n_scenarios, count(DISTINCT planner) AS np, min(planner) AS one, count(*) FILTER (NOT score BETWEEN 0 AND 1) AS bad, count(score) AS n_scored, avg(score) AS mean
FROM planner_outcome WHERE run_id IS NOT NULL GROUP BY 1) SELECT r.run, n_rows, n_scenarios, n_scored, CASE WHEN np <> 1 THEN 'several planners' WHEN one <> planner THEN 'other planner' WHEN bad > 0 THEN 'bad score' WHEN n_rows <> n_scenarios THEN 'repeated scenario'
WHEN n_scored <> scored THEN 'other number of scores' WHEN coalesce(abs(mean - official_score) > 1e-3, true) THEN 'other mean' ELSE 'ok' END AS status FROM r JOIN p ON p.run = r.run WHERE nth = 1""",
    "run_compatibility": f"""WITH n AS (SELECT *, lower(trim(run_id, {_WS})) AS run, lower(trim(regexp_extract(run_id, '^\\s*(.*)_sweep_', 1), {_WS})) AS name, regexp_extract(runner_report, '^([^/]*)/', 1) AS place FROM run_result WHERE run_id IS NOT NULL),
g AS (SELECT planner, count(DISTINCT run) AS n_runs, count(DISTINCT name) AS n_names, count(*) FILTER (name <> planner) AS n_other_name, count(DISTINCT requested) AS n_requests, count(DISTINCT place) AS n_places FROM n GROUP BY 1)
SELECT *, n_names = 1 AND n_other_name = 0 AND n_places = 1 AS compatible FROM g""",
}
QUERIES = {f.__name__: f for f in (scenario_keys, outcome_failures, planner_labels, modeling_table, modeling_coverage, identity_mismatches, delivery_disagreements, missing_policies, policy_rows, run_validation, run_compatibility)}
