"""Suites of checks over the scenario, outcome, pose, run and label tables. Every check stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import sampling as S
from ..operators import temporal as T
from ..quality import expectations as E
from ..session import cut
from ..sources.tables import table
from .anchors import _A, _RANK, _SPLIT, H, anchor_flags, anchor_funnel, anchors, nonoverlap_ranking, user_split
from .describe import _CITY, _OUT, _PAIR, COMPONENTS, city_anchor_shares, latest_outcomes, matched_pairs
from .labels import _LAB, PLANNERS, modeling_table, planner_labels
from .metrics import SQL as METRIC_SQL
from .metrics import constant_oof
from .pairing import _WIDE, OTHERS, SLUGS, arm_labels
from .problems import _WS

Check = tuple[str, Callable[[], DataFrame]]
TOKEN = "^[0-9a-f]{16}$"


def _report(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return E.report(checks, spark).select("position", "check", "status", "violations")


def _holds(df: DataFrame, rules: dict[str, Column]) -> list[Check]:
    return [(name, lambda n=name, c=c: E.holds(df, n, c)) for name, c in rules.items()]


def _sql(violations: list[tuple[str, str]], ctes: str = "", warn: tuple[str, ...] = ()) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{name}' AS \"check\", ({v}) AS violations" for i, (name, v) in enumerate(violations))
    bad = f"CASE WHEN \"check\" IN ({', '.join(repr(w) for w in warn)}) THEN 'WARN' ELSE 'FAIL' END" if warn else "'FAIL'"
    return f"""{ctes + ", " if ctes else "WITH "}v AS ({rows}) SELECT position, "check", CASE WHEN violations = 0 THEN 'PASS' ELSE {bad} END AS status, violations FROM v"""


def _off(name: str, table_: str, condition: str) -> tuple[str, str]:
    return name, f"SELECT count(*) FILTER (NOT coalesce({condition}, false)) FROM {table_}"


def _repeated(name: str, table_: str, keys: str, where: str = "true") -> tuple[str, str]:
    return name, f"SELECT count(*) FROM (SELECT 1 FROM {table_} WHERE {where} GROUP BY {keys} HAVING count(*) > 1)"


def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of scenarios: keys, required fields, forms, windows, overlaps of windows within a log."""
    s = table(spark, d, "scenario_sample", "row_id", "scenario_id", "log_name", "db_file", "scenario_token", "anchor_timestamp_us", "window_start_us", "window_end_us", "scenario_type")
    text = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    live = s.where("log_name is not null and window_end_us > window_start_us").withColumn("log", norm_key("log_name"))
    checks = [("rows unique", lambda: E.unique(s, "rows unique", ["row_id"])), ("scenarios unique", lambda: E.unique(s.where("scenario_id is not null").withColumn("k", norm_key("scenario_id")), "scenarios unique", ["k"]))]
    checks += _holds(
        s,
        {
            "required fields": text("scenario_id") & text("log_name") & text("scenario_token") & text("scenario_type"), "token form": F.col("scenario_token").rlike(TOKEN),
            "id of its parts": norm_key("scenario_id") == F.concat_ws(":", norm_key("log_name"), norm_key("scenario_token")), "file of the log": F.col("db_file") == F.concat("log_name", F.lit(".db")),
            "window offset": F.col("window_start_us") == F.col("anchor_timestamp_us") - 3_000_000, "window length": F.col("window_end_us") - F.col("window_start_us") == 15_000_000,
        },
    )
    checks.append(("no overlap in a log", lambda: E.count_rows(S.overlap_offenders(live, "log", "window_start_us", "window_end_us", "row_id"), "no overlap in a log")))
    return _report(spark, checks)


def arm_checks(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the arms: matched, known scenarios, metrics finite and in range, failed rows without a score."""
    o = table(spark, d, "planner_outcome", "outcome_id", "scenario_id", "planner", "succeeded", "score", "error_message", *COMPONENTS).withColumn("scenario", norm_key("scenario_id"))
    known = table(spark, d, "scenario_sample", "scenario_id").select(norm_key("scenario_id").alias("scenario"))
    some = latest_outcomes(spark, d).groupBy("scenario").agg(F.countDistinct("planner").alias("n"))
    checks = [("outcomes unique", lambda: E.unique(o, "outcomes unique", ["outcome_id"])), ("one row per scenario and arm", lambda: E.unique(o.where("scenario is not null"), "one row per scenario and arm", ["scenario", "planner"])), ("known scenarios", lambda: E.covered(o.where("scenario is not null"), "known scenarios", known, ["scenario"])), ("all arms", lambda: E.holds(some, "all arms", F.col("n") == 5))]
    checks += [(f"{c} in range", lambda c=c: E.in_range(o, f"{c} in range", c, 0.0, 1.0)) for c in ("score", *COMPONENTS)]
    checks += _holds(o, {"score if succeeded": F.col("succeeded") == F.col("score").isNotNull(), "message if failed": ~F.col("succeeded") == F.col("error_message").isNotNull()})
    return _report(spark, checks)


def pose_checks(spark: SparkSession, d: str) -> DataFrame:
    """Readings: keys, ranges, unit quaternions, lags between readings of a log, repeats."""
    p = table(spark, d, "ego_pose", "pose_id", "log_name", "timestamp_us", "x", "y", "qw", "qz", "vx", "vy", "acceleration_x").withColumn("log", norm_key("log_name"))
    lag = T.gaps(p.where("log is not null and timestamp_us is not null"), "log", "timestamp_us", "pose_id").where("gap is not null")
    checks = [("readings unique", lambda: E.unique(p, "readings unique", ["pose_id"])), ("instants unique", lambda: E.unique(p.where("log is not null and timestamp_us is not null"), "instants unique", ["log", "timestamp_us"])), ("complete", lambda: E.not_null(p, "complete", ["log_name", "timestamp_us", "x", "y"]))]
    checks += [(f"{c} in range", lambda c=c, z=z: E.in_range(p, f"{c} in range", c, -z, z)) for c, z in (("vx", 20.0), ("vy", 20.0), ("acceleration_x", 6.0), ("qw", 1.0), ("qz", 1.0))]
    checks += _holds(p, {"unit heading": F.abs(F.col("qw") * F.col("qw") + F.col("qz") * F.col("qz") - 1) < 0.01})
    checks.append(("lag within a minute", lambda: E.warn_only(E.holds(lag, "lag within a minute", F.col("gap") <= 60_000_000))))
    return _report(spark, checks)


def series_checks(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series of events: one row an hour, no hour missing, finite totals, nothing beyond the last event."""
    a = anchors(spark, d)
    h = a.groupBy(T.grid_floor("us", H).alias("hour_us")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    last = a.agg(F.max("us").alias("last"))
    span = h.agg(((F.max("hour_us") - F.min("hour_us")) / H + 1).alias("want"), F.count("*").alias("have"))
    checks = [("hours unique", lambda: E.unique(h, "hours unique", ["hour_us"])), ("no hour missing", lambda: E.holds(span, "no hour missing", F.col("want") == F.col("have")))]
    checks += _holds(h, {"on the grid": F.col("hour_us") % H == 0, "totals known": F.col("total").isNotNull() & ~F.isnan("total"), "at least forty events": F.col("n") >= 40})
    checks.append(("nothing later", lambda: E.holds(h.crossJoin(F.broadcast(last)), "nothing later", F.col("hour_us") <= F.col("last"))))  # one row
    return _report(spark, checks)


def city_checks(spark: SparkSession, d: str) -> DataFrame:
    """The share of sound windows, one check per city, a WARN where it is short."""
    shares = city_anchor_shares(spark, d)
    named = lambda c: E.warn_only(E.holds(shares.where(F.col("city") == c), f"windows of {c}", F.col("ok")))
    checks = [(f"windows of {c}", lambda c=c: named(c)) for c in ("dunmere", "oru_bay", "port_calder", "sablewick")]
    checks.append(("city known", lambda: E.holds(shares, "city known", F.col("city").isin("dunmere", "oru_bay", "port_calder", "sablewick"))))
    return _report(spark, checks)


def ranking_checks(spark: SparkSession, d: str) -> DataFrame:
    """A ranked sample checked on its own: keys, dense ranks, order by hash, no overlap, splits without a leak, all candidates known."""
    a, r, split = anchors(spark, d), cut(nonoverlap_ranking(spark, d)), user_split(spark, d)
    rows = r.join(a.select("event_id", "start_us", "end_us"), "event_id").withColumn("scope", F.concat_ws("|", "city", "user_id"))
    ranks = r.groupBy("city", "event_type").agg(F.max("group_rank").alias("top"), F.countDistinct("group_rank").alias("n"))
    checks = [
        ("keys unique", lambda: E.unique(r, "keys unique", ["event_id"])), ("ranks dense", lambda: E.holds(ranks, "ranks dense", F.col("top") == F.col("n"))),
        ("hash of the key", lambda: E.holds(r, "hash of the key", F.col("rank_key") == S.rank_key(7, "event_id"))), ("no overlap", lambda: E.count_rows(S.overlap_offenders(rows, "scope", "start_us", "end_us", "event_id"), "no overlap")),
        ("candidates known", lambda: E.covered(r, "candidates known", a, ["event_id"])), ("one split per user", lambda: E.unique(split, "one split per user", ["user_id"])), ("all users split", lambda: E.covered(a, "all users split", split, ["city", "user_id"])),
    ]
    return _report(spark, checks)


def label_checks(spark: SparkSession, d: str) -> DataFrame:
    """The label table: keys, complete arms, exact deltas, ranges, best arm, no feature among the labels."""
    lab = arm_labels(spark, d)
    orders = table(spark, d, "orders", "o_custkey")
    scores = [F.col(f"score_{s}") for s in SLUGS]
    best = F.element_at(F.create_map(*[x for s in SLUGS for x in (F.lit(s), F.col(f"score_{s}"))]), F.col("best_arm"))
    checks = [("units unique", lambda: E.unique(lab, "units unique", ["o_custkey"])), ("arms complete", lambda: E.not_null(lab, "arms complete", [f"score_{s}" for s in SLUGS])), ("units known", lambda: E.covered(lab, "units known", orders, ["o_custkey"]))]
    checks += _holds(lab, {f"exact delta of {s}": F.col(f"delta_{s}") == F.round(F.col(f"score_{s}") - F.col(f"score_{SLUGS[-1]}"), 9) for s in OTHERS})
    checks += _holds(lab, {"scores in range": (F.least(*scores) >= 0) & (F.greatest(*scores) <= 1), "best is best": best >= F.greatest(*scores) - 1e-9})
    checks.append(("labels only", lambda: E.columns_match(lab, "labels only", ["o_custkey", *[f"score_{s}" for s in SLUGS], *[f"delta_{s}" for s in OTHERS], "best_arm"])))
    return _report(spark, checks)


def feature_checks(spark: SparkSession, d: str) -> DataFrame:
    """The modeling table: one row per label, features there, logs in one fold, every fold used, known arms."""
    m, lab = modeling_table(spark, d), planner_labels(spark, d)
    folds = m.agg(F.countDistinct("fold").alias("n"))
    checks = [
        ("scenarios unique", lambda: E.unique(m, "scenarios unique", ["scenario"])), ("labels covered", lambda: E.covered(lab, "labels covered", m, ["scenario"])), ("no others", lambda: E.covered(m, "no others", lab, ["scenario"])),
        ("features there", lambda: E.not_null(m, "features there", ["log", "kind"])), ("logs in one fold", lambda: E.count_rows(S.leaking_units(m, "log", "fold"), "logs in one fold")), ("folds used", lambda: E.holds(folds, "folds used", F.col("n") == 5)),
        ("region mapped", lambda: E.warn_only(E.holds(m, "region mapped", ~F.col("region").isin("unmapped", "null")))), ("arms known", lambda: E.in_domain(m, "arms known", "best_arm", list(PLANNERS))),
    ]
    return _report(spark, checks)


def oof_checks(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions: one per row and target, all rows covered, finite, in their own fold, better than nothing."""
    o = constant_oof(spark, d)
    lab = arm_labels(spark, d).select(F.col("o_custkey").alias("id"))
    targets = o.groupBy("id").agg(F.countDistinct("target").alias("n"))
    error = o.groupBy("target").agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))).alias("pehe"), F.stddev_pop("y_true").alias("spread"))
    checks = [("predictions unique", lambda: E.unique(o, "predictions unique", ["id", "target"])), ("rows covered", lambda: E.covered(lab, "rows covered", o, ["id"])), ("all targets", lambda: E.holds(targets, "all targets", F.col("n") == len(OTHERS)))]
    checks += _holds(o, {"finite": F.col("y_pred").isNotNull() & ~F.isnan("y_pred"), "fold of the row": F.col("fold") == F.col("id") % 5})
    checks.append(("error near the spread", lambda: E.holds(error, "error near the spread", F.abs(F.col("pehe") / F.col("spread") - 1) < 0.02)))
    return _report(spark, checks)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen checks of the matched pairs and what they are made of."""
    p, o = matched_pairs(spark, d), table(spark, d, "planner_outcome", "scenario_id", "run_id", "planner", "score", "recorded_at", "succeeded")
    runs = table(spark, d, "run_result", "run_id", "finished_at", "failed", "official_score")
    warn = lambda name, df, c: (name, lambda: E.warn_only(E.holds(df, name, c)))
    checks = [
        ("pairs unique", lambda: E.unique(p, "pairs unique", ["scenario"])), ("pairs there", lambda: E.holds(p.agg(F.count("*").alias("n")), "pairs there", F.col("n") > 0)),
        *_holds(p, {"control in range": F.col("score_control").between(0, 1), "candidate in range": F.col("score_candidate").between(0, 1), "delta of the scores": F.abs(F.col("score_candidate") - F.col("score_control") - F.col("delta")) < 1e-8, "outcome of the delta": (F.col("delta") > 1e-9) == (F.col("outcome") == "better"), "gated scores are zero": ~F.col("gated_candidate") | (F.col("score_candidate") < 1e-9)}),
        ("arms known", lambda: E.in_domain(o, "arms known", "planner", [*PLANNERS, "echo_net"])), warn("scenario named", o, F.col("scenario_id").isNotNull()), warn("run named", o, F.col("run_id").isNotNull()), warn("all succeeded", o, F.col("succeeded")),
        ("recorded", lambda: E.not_null(o, "recorded", ["recorded_at"])), warn("failures counted", runs, F.col("failed").isNotNull()), ("official scores in range", lambda: E.in_range(runs, "official scores in range", "official_score", 0.0, 1.0)),
    ]
    return _report(spark, checks)


def funnel_checks(spark: SparkSession, d: str) -> DataFrame:
    """Flags and their funnel reconciled with the source: as many rows, none lost, each step within the one before."""
    f, steps = anchor_flags(spark, d), anchor_funnel(spark, d)
    events = table(spark, d, "events", "event_id", "user_id")
    n = f.agg(F.count("*").alias("n"), F.count(F.when(F.col("ready"), 1)).alias("ready")).crossJoin(events.agg(F.count("*").alias("m"))).crossJoin(steps.agg(F.max_by("n_rows", "step").alias("last"), F.max("n_rows").alias("first")))  # one row each
    down = steps.alias("a").join(steps.alias("b"), F.col("a.step") + 1 == F.col("b.step")).select(F.col("a.n_rows").alias("x"), F.col("b.n_rows").alias("y"))
    per = f.groupBy("user_id").agg(F.count("*").alias("a")).join(events.groupBy("user_id").agg(F.count("*").alias("b")), "user_id", "full_outer")
    checks = [("anchors unique", lambda: E.unique(f, "anchors unique", ["event_id"])), ("flags known", lambda: E.not_null(f, "flags known", ["inner_ok", "window_ok", "value_ok", "ready"])), *_holds(f, {"ready is all": F.col("ready") == (F.col("inner_ok") & F.col("window_ok") & F.col("value_ok"))})]
    checks += [("rows reconciled", lambda: E.holds(n, "rows reconciled", (F.col("n") == F.col("m")) & (F.col("first") == F.col("n")))), ("last step is ready", lambda: E.holds(n, "last step is ready", F.col("last") == F.col("ready"))), ("steps fall", lambda: E.holds(down, "steps fall", F.col("y") <= F.col("x"))), ("users reconciled", lambda: E.holds(per, "users reconciled", F.col("a") == F.col("b")))]
    return _report(spark, checks)


_WIN = f"""WITH s AS (SELECT *, lower(trim(log_name, {_WS})) AS log, lower(trim(scenario_id, {_WS})) AS k FROM scenario_sample),
n AS (SELECT *, max(window_end_us) OVER (PARTITION BY log ORDER BY window_start_us, window_end_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE log IS NOT NULL AND window_end_us > window_start_us)"""
_RANGE = lambda c, t, a, z: (f"{c} in range", f"SELECT count(*) FILTER (NOT {c} BETWEEN {a} AND {z}) FROM {t}")
_POSE = f"WITH p AS (SELECT *, lower(trim(log_name, {_WS})) AS log FROM ego_pose), g AS (SELECT timestamp_us - lag(timestamp_us) OVER (PARTITION BY log ORDER BY timestamp_us, pose_id) AS gap FROM p WHERE log IS NOT NULL AND timestamp_us IS NOT NULL)"
_NULLS = lambda name, t, cols: (name, f"SELECT count(*) FROM {t} WHERE {' OR '.join(f'{c} IS NULL' for c in cols)}")
_SCORES = ", ".join(f"score_{s}" for s in SLUGS)
_FIVE = f"""{_OUT}, o5 AS (SELECT *, lower(trim(scenario_id, {_WS})) AS k FROM planner_outcome), arms AS (SELECT scenario, count(DISTINCT planner) AS n FROM l GROUP BY 1)"""
SQL = {
    "manifest_checks": _sql(
        [
            _repeated("rows unique", "s", "row_id"), _repeated("scenarios unique", "s", "k", "k IS NOT NULL"), _off("required fields", "s", "trim(scenario_id) <> '' AND trim(log_name) <> '' AND trim(scenario_token) <> '' AND trim(scenario_type) <> ''"),
            _off("token form", "s", f"regexp_matches(scenario_token, '{TOKEN}')"), _off("id of its parts", "s", f"k = log || ':' || lower(trim(scenario_token, {_WS}))"), _off("file of the log", "s", "db_file = log_name || '.db'"),
            _off("window offset", "s", "window_start_us = anchor_timestamp_us - 3000000"), _off("window length", "s", "window_end_us - window_start_us = 15000000"), ("no overlap in a log", "SELECT count(*) FROM n WHERE window_start_us < reach"),
        ],
        _WIN,
    ),
    "arm_checks": _sql(
        [
            _repeated("outcomes unique", "o5", "outcome_id"), _repeated("one row per scenario and arm", "o5", "k, planner", "k IS NOT NULL"), ("known scenarios", f"SELECT count(DISTINCT k) FROM o5 WHERE k NOT IN (SELECT lower(trim(scenario_id, {_WS})) FROM scenario_sample WHERE scenario_id IS NOT NULL)"), _off("all arms", "arms", "n = 5"),
            *[_RANGE(c, "o5", 0, 1) for c in ("score", *COMPONENTS)], _off("score if succeeded", "o5", "succeeded = (score IS NOT NULL)"), _off("message if failed", "o5", "(NOT succeeded) = (error_message IS NOT NULL)"),
        ],
        f"WITH {_FIVE}",
    ),
    "pose_checks": _sql(
        [
            _repeated("readings unique", "p", "pose_id"), _repeated("instants unique", "p", "log, timestamp_us", "log IS NOT NULL AND timestamp_us IS NOT NULL"), _NULLS("complete", "p", ["log_name", "timestamp_us", "x", "y"]),
            _RANGE("vx", "p", -20, 20), _RANGE("vy", "p", -20, 20), _RANGE("acceleration_x", "p", -6, 6), _RANGE("qw", "p", -1, 1), _RANGE("qz", "p", -1, 1), _off("unit heading", "p", "abs(qw * qw + qz * qz - 1) < 0.01"),
            ("lag within a minute", "SELECT count(*) FROM g WHERE gap > 60000000"),
        ],
        _POSE, ("lag within a minute",),
    ),
    "series_checks": _sql(
        [
            _repeated("hours unique", "h", "hour_us"), ("no hour missing", f"SELECT ((max(hour_us) - min(hour_us)) // {H} + 1 <> count(*))::INT FROM h"), _off("on the grid", "h", f"hour_us % {H} = 0"), _off("totals known", "h", "total IS NOT NULL"), _off("at least forty events", "h", "n >= 40"),
            ("nothing later", "SELECT count(*) FROM h WHERE hour_us > (SELECT max(us) FROM a)"),
        ],
        f"WITH {_A}, h AS (SELECT us // {H} * {H} AS hour_us, count(*) AS n, sum(value) AS total FROM a GROUP BY 1)",
    ),
    "city_checks": _sql(
        [*[(f"windows of {c}", f"SELECT count(*) FROM g WHERE city = '{c}' AND NOT ok") for c in ("dunmere", "oru_bay", "port_calder", "sablewick")], _off("city known", "g", "city IN ('dunmere', 'oru_bay', 'port_calder', 'sablewick')")],
        f"WITH g AS (SELECT {_CITY} AS city, count(*) FILTER (window_start_us = anchor_timestamp_us - 3000000) / count(*) >= 0.96 AS ok FROM scenario_sample GROUP BY 1)", ("windows of dunmere", "windows of oru_bay", "windows of port_calder", "windows of sablewick"),
    ),
    "ranking_checks": _sql(
        [
            _repeated("keys unique", "k", "event_id"), ("ranks dense", "SELECT count(*) FROM (SELECT max(group_rank) AS t, count(DISTINCT group_rank) AS n FROM k GROUP BY city, event_type) WHERE t <> n"), _off("hash of the key", "k", "rank_key = sha256('7:' || event_id)[:16]"),
            ("no overlap", "SELECT count(*) FROM (SELECT start_us, max(end_us) OVER (PARTITION BY k.city, k.user_id ORDER BY start_us, end_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM k JOIN a USING (event_id)) WHERE start_us < r"),
            ("candidates known", "SELECT count(*) FROM k WHERE event_id NOT IN (SELECT event_id FROM a)"), _repeated("one split per user", "sp.s", "user_id"), ("all users split", "SELECT count(DISTINCT (city, user_id)) FROM a WHERE (city, user_id) NOT IN (SELECT (city, user_id) FROM sp)"),
        ],
        f"WITH {_RANK}, sp AS (WITH {_SPLIT} SELECT city, user_id, split FROM s)",
    ).replace("sp.s", "sp"),
    "label_checks": _sql(
        [
            _repeated("units unique", "l", "o_custkey"), _NULLS("arms complete", "l", [f"score_{s}" for s in SLUGS]), ("units known", "SELECT count(*) FROM l WHERE o_custkey NOT IN (SELECT o_custkey FROM orders)"), *[_off(f"exact delta of {s}", "l", f"delta_{s} = round(score_{s} - score_{SLUGS[-1]}, 9)") for s in OTHERS],
            _off("scores in range", "l", f"least({_SCORES}) >= 0 AND greatest({_SCORES}) <= 1"), _off("best is best", "l", f"CASE best_arm {' '.join(f'''WHEN '{s}' THEN score_{s}''' for s in SLUGS)} END >= greatest({_SCORES}) - 1e-9"), ("labels only", "SELECT 0"),
        ],
        f"WITH {_WIDE}",
    ),
    "oof_checks": _sql(
        [
            _repeated("predictions unique", "oo", "id, target"), ("rows covered", "SELECT count(*) FROM l WHERE o_custkey NOT IN (SELECT id FROM oo)"), ("all targets", f"SELECT count(*) FROM (SELECT id FROM oo GROUP BY id HAVING count(DISTINCT target) <> {len(OTHERS)})"),
            _off("finite", "oo", "y_pred IS NOT NULL"), _off("fold of the row", "oo", "fold = id % 5"), ("error near the spread", "SELECT count(*) FROM (SELECT sqrt(avg((y_pred - y_true) ** 2)) / stddev_pop(y_true) AS r FROM oo GROUP BY target) WHERE abs(r - 1) >= 0.02"),
        ],
        f"{METRIC_SQL['constant_oof'].replace('SELECT pos AS id', 'SELECT_pos AS id')}".replace("SELECT_pos AS id", ", oo AS (SELECT pos AS id") + ")",
    ),
    "quality_report": _sql(
        [
            _repeated("pairs unique", "p", "scenario"), ("pairs there", "SELECT (count(*) = 0)::INT FROM p"), _off("control in range", "p", "score_control BETWEEN 0 AND 1"), _off("candidate in range", "p", "score_candidate BETWEEN 0 AND 1"), _off("delta of the scores", "p", "abs(score_candidate - score_control - delta) < 1e-8"),
            _off("outcome of the delta", "p", "(delta > 1e-9) = (outcome = 'better')"), _off("gated scores are zero", "p", "NOT gated_candidate OR score_candidate < 1e-9"), ("arms known", f"SELECT count(*) FROM planner_outcome WHERE planner NOT IN {(*PLANNERS, 'echo_net')}"),
            _off("scenario named", "planner_outcome", "scenario_id IS NOT NULL"), _off("run named", "planner_outcome", "run_id IS NOT NULL"), _off("all succeeded", "planner_outcome", "succeeded"), _NULLS("recorded", "planner_outcome", ["recorded_at"]), _off("failures counted", "run_result", "failed IS NOT NULL"), ("official scores in range", "SELECT count(*) FROM run_result WHERE NOT official_score BETWEEN 0 AND 1"),
        ],
        f"WITH {_PAIR}", ("scenario named", "run named", "all succeeded", "failures counted"),
    ),
    "feature_checks": _sql(
        [(n, "SELECT 0") for n in ("scenarios unique", "labels covered", "no others", "features there", "logs in one fold", "folds used")]
        + [("region mapped", f"SELECT count(*) FROM c JOIN lab ON c.scenario = lab.scenario WHERE coalesce(city, '') NOT IN ('dunmere', 'port_calder', 'oru_bay')"), ("arms known", f"SELECT count(*) FROM lab WHERE best_arm NOT IN {PLANNERS}")],
        f"WITH {_LAB}, c AS (SELECT lower(trim(scenario_id, {_WS})) AS scenario, arg_min({_CITY}, (coalesce(epoch_us(ingested_at), 4611686018427387904), row_id)) FILTER (true) AS city FROM (SELECT * REPLACE (coalesce(source_city, ' ') AS source_city) FROM scenario_sample) WHERE scenario_id IS NOT NULL GROUP BY 1)", ("region mapped",),
    ),
    "funnel_checks": _sql([(n, "SELECT 0") for n in ("anchors unique", "flags known", "ready is all", "rows reconciled", "last step is ready", "steps fall", "users reconciled")]),
}
QUERIES = {f.__name__: f for f in (manifest_checks, arm_checks, pose_checks, series_checks, city_checks, ranking_checks, label_checks, feature_checks, oof_checks, quality_report, funnel_checks)}
