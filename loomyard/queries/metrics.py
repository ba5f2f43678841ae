"""Metrics of predicted against true deltas per arm, resampling and simple models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..metrics import evaluation as V
from ..metrics import uplift as U
from ..models import oof
from ..session import cut
from ..sources.tables import table
from .pairing import _WIDE, OTHERS, SLUGS, arm_labels

#: Draws of the bootstraps.
RESAMPLES, CLUSTER_RESAMPLES = 1_000, 10_000


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(arm, pos, fold, y_true, y_pred): a stand-in predictor that mixes the true delta with the control's score."""
    lab = arm_labels(spark, d)
    long = lab.unpivot(["o_custkey", f"score_{SLUGS[-1]}"], [f"delta_{a}" for a in OTHERS], "arm", "y_true")
    pred = F.round(F.round(F.col("y_true") * 0.3, 2) + F.col(f"score_{SLUGS[-1]}") * 0.1, 2)
    return cut(long.select("arm", F.col("o_custkey").alias("pos"), (F.col("o_custkey") % 5).alias("fold"), "y_true", pred.alias("y_pred")))


def pehe_mae(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("arm", "fold").agg(F.count("*").alias("n"), F.round(U.pehe(), 6).alias("pehe"), F.round(U.mae(), 6).alias("mae"))


def spearman_avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return U.spearman(predictions(spark, d), ["arm"]).withColumn("spearman", F.round("spearman", 6))


def topk_recall(spark: SparkSession, d: str) -> DataFrame:
    return U.topk_recall(predictions(spark, d), ["arm"], 0.25).withColumn("topk_recall", F.round("topk_recall", 6))


def qini(spark: SparkSession, d: str) -> DataFrame:
    return U.qini(predictions(spark, d), ["arm"]).withColumn("qini", F.round("qini", 6))


def best_arm_per_fold(spark: SparkSession, d: str) -> DataFrame:
    """Per fold the arm of greatest mean delta on the other folds (first in name order on ties)."""
    per = predictions(spark, d).groupBy("arm", "fold").agg(F.sum("y_true").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("arm")
    other = per.withColumn("m", F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c")), 9))
    return other.groupBy("fold").agg(F.min_by("arm", F.struct(-F.col("m"), "arm")).alias("best_arm"), F.round(F.max("m"), 6).alias("mean_elsewhere"))


def bootstrap_hash_ci(spark: SparkSession, d: str) -> DataFrame:
    out = U.hash_bootstrap(predictions(spark, d), ["arm"], "y_true", "pos", draws=RESAMPLES, salt="boot")
    return out.select("arm", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    rows = predictions(spark, d).join(c, F.col("pos") == F.col("c_custkey"))
    return U.cluster_bootstrap(rows, "c_nationkey", "y_true", draws=CLUSTER_RESAMPLES, salt="cluster").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    out = V.metric_bundle(predictions(spark, d), ["arm"])
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("pehe", "mae", "spearman", "topk_10", "topk_25", "qini")])


def gain_curve(spark: SparkSession, d: str) -> DataFrame:
    exact = predictions(spark, d).withColumn("y", F.col("y_true").cast("decimal(14,9)"))
    out = V.running_total(exact, ["arm"], F.col("y_pred").desc(), "y", "gain")
    return out.select("arm", "step", F.col("gain").cast("double").alias("gain"))


def segment_errors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    out = V.group_errors(predictions(spark, d).join(c, F.col("pos") == F.col("c_custkey")), ["arm"], "c_mktsegment")
    return out.select("arm", "c_mktsegment", "n", F.round("pehe", 6).alias("pehe"), F.round("bias", 6).alias("bias"))


def largest_errors(spark: SparkSession, d: str) -> DataFrame:
    """The five largest errors over all arms."""
    p = predictions(spark, d).withColumn("y_pred", F.round("y_pred", 9)).withColumn("y_true", F.round("y_true", 9))
    return V.largest_errors(p, 5, [f"delta_{a}" for a in OTHERS]).select("arm", "pos", F.round("error", 9).alias("error"))


def card_differences(spark: SparkSession, d: str) -> DataFrame:
    """The report card of folds 0 to 2 against that of all: metrics that differ by more than a thousandth."""
    p = predictions(spark, d)
    card = lambda df: df.groupBy("arm").agg(F.round(U.pehe(), 9).alias("pehe"), F.round(U.mae(), 9).alias("mae"), F.count("*").cast("double").alias("n"))
    out = V.card_differences(card(p.where("fold < 3")), card(p), ["arm"], ["pehe", "mae", "n"], 1e-3)
    return out.select("arm", "metric", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


def model_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per arm the better of the mean elsewhere and the stand-in predictor, ties to the first."""
    p = predictions(spark, d)
    per = p.groupBy("arm", "fold").agg(F.sum("y_true").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("arm")
    mean = per.select("arm", "fold", ((F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c"))).alias("m"))
    both = p.select("arm", F.lit("stand_in").alias("model"), "y_true", "y_pred").unionByName(p.join(mean, ["arm", "fold"]).select("arm", F.lit("constant").alias("model"), "y_true", F.col("m").alias("y_pred")))
    return V.choose_model(both, "arm", "model", ["constant", "stand_in"]).select("arm", "model", F.round("pehe", 6).alias("pehe"))


def variance_test(spark: SparkSession, d: str) -> DataFrame:
    """Do scenario types differ in their mean outcome? Tested against brute force."""
    return V.permutation_test(table(spark, d, "planner_outcome", "scenario_type", "score"), "scenario_type", "score", most_rows=1_000_000)


def ridge_importance(spark: SparkSession, d: str) -> DataFrame:
    """Permutation importance of the ridge features over the folds; tested on a planted effect."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    lab = cut(arm_labels(spark, d).withColumn("fold", F.col("o_custkey") % 5).join(c, F.col("o_custkey") == F.col("c_custkey")))
    per = oof.fold_importance(lab, f"delta_{OTHERS[0]}", numeric=["c_acctbal", "c_nationkey"], categorical=["c_mktsegment"], row="o_custkey", fold="fold")
    return V.leading_features(per, 10, ["c_acctbal", "c_nationkey", "c_mktsegment"])


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return U.histogram(table(spark, d, "planner_outcome", "score"), "score", 0.0, 1.0, 20)


def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    out = U.signed_rank(predictions(spark, d), "y_true", "pos", ["arm"])
    return out.select("arm", "n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


def constant_oof(spark: SparkSession, d: str) -> DataFrame:
    lab = arm_labels(spark, d).withColumn("fold", F.col("o_custkey") % 5)
    out = reduce(DataFrame.unionByName, [oof.constant(lab, f"delta_{a}", row="o_custkey", fold="fold") for a in OTHERS])
    return out.select("id", "fold", "target", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))


def ridge_oof(spark: SparkSession, d: str) -> DataFrame:
    """Tested against the closed form in tests/test_operators.py."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    lab = cut(arm_labels(spark, d).withColumn("fold", F.col("o_custkey") % 5).join(c, F.col("o_custkey") == F.col("c_custkey")))
    return reduce(DataFrame.unionByName, [oof.ridge(lab, f"delta_{a}", numeric=["c_acctbal"], categorical=["c_mktsegment"], row="o_custkey", fold="fold") for a in OTHERS])


_P = f"""WITH {_WIDE}, z AS (UNPIVOT (SELECT o_custkey, score_{SLUGS[-1]} AS c, {", ".join(f"delta_{a}" for a in OTHERS)} FROM l) ON {", ".join(f"delta_{a}" for a in OTHERS)} INTO NAME arm VALUE y_true),
p AS (SELECT arm, o_custkey AS pos, o_custkey % 5 AS fold, y_true, round(round(y_true * 0.3, 2) + c * 0.1, 2) AS y_pred FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY y_pred DESC, pos) AS bp, row_number() OVER (PARTITION BY arm ORDER BY y_true DESC, pos) AS bt, count(*) OVER (PARTITION BY arm) AS n FROM p)"""


def _weight(salt: str, unit: str) -> str:
    """The Poisson weight of a unit in draw g.draw, whose multiplier is g.a."""
    u = f"((('0x' || sha256('{salt}:' || {unit})[:12])::BIGINT % {U.PRIME - 1} + 1) * g.a % {U.PRIME}) / {U.PRIME}.0::DOUBLE"
    return f"len(list_filter({[repr(e) for e in U.poisson_edges()]}::DOUBLE[], lambda e: e <= {u}))"


def _draws(n: int) -> str:
    return f"g(draw, a) AS (SELECT 0, {U.FACTOR}::BIGINT UNION ALL SELECT draw + 1, a * {U.FACTOR} % {U.PRIME} FROM g WHERE draw < {n - 1})"


SQL = {
    "pehe_mae": f"{_P} SELECT arm, fold, count(*) AS n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS pehe, round(avg(abs(y_pred - y_true)), 6) AS mae FROM p GROUP BY ALL",
    "spearman_avg_rank": f"""{_P}, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY y_true) + (count(*) OVER (PARTITION BY arm, y_true) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY arm ORDER BY y_pred) + (count(*) OVER (PARTITION BY arm, y_pred) - 1) / 2.0::DOUBLE AS b FROM p) SELECT arm, round(corr(a, b), 6) AS spearman FROM r GROUP BY arm""",
    "topk_recall": f"{_P} SELECT arm, round(count(*) FILTER (bt <= ceil(round(n * 0.25, 9)) AND bp <= ceil(round(n * 0.25, 9))) / max(ceil(round(n * 0.25, 9))), 6) AS topk_recall FROM k GROUP BY arm",
    "qini": f"{_P} SELECT arm, round((sum(y_true * (n - bp + 0.5)) - max(n) * sum(y_true) / 2) / (sum(y_true * (n - bt + 0.5)) - max(n) * sum(y_true) / 2), 6) AS qini FROM k GROUP BY arm",
    "best_arm_per_fold": f"""{_P}, g AS (SELECT arm, fold, sum(y_true) AS s, count(*) AS c FROM p GROUP BY ALL),
m AS (SELECT arm, fold, round((sum(s) OVER (PARTITION BY arm) - s) / (sum(c) OVER (PARTITION BY arm) - c), 9) AS m FROM g)
SELECT fold, arg_min(arm, (-m, arm)) AS best_arm, round(max(m), 6) AS mean_elsewhere FROM m GROUP BY fold""",
    "bootstrap_hash_ci": f"""{_P.replace("WITH", "WITH RECURSIVE", 1)}, {_draws(RESAMPLES)}, bw AS (SELECT arm, draw, y_true, {_weight("boot", "pos")} AS w FROM p, g),
m AS (SELECT arm, draw, sum(y_true * w) / nullif(sum(w), 0) AS m FROM bw GROUP BY ALL) SELECT arm, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY arm""",
    "cluster_bootstrap": f"""{_P.replace("WITH", "WITH RECURSIVE", 1)}, {_draws(CLUSTER_RESAMPLES)}, s AS (SELECT c_nationkey, sum(y_true) AS s, count(y_true) AS c FROM p JOIN customer ON pos = c_custkey GROUP BY 1),
bw AS (SELECT draw, s, c, {_weight("cluster", "c_nationkey")} AS w FROM s, g), m AS (SELECT draw, sum(s * w) / nullif(sum(c * w), 0) AS m FROM bw GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "metric_bundle": f"""{_P}, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY y_true) + (count(*) OVER (PARTITION BY arm, y_true) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY arm ORDER BY y_pred) + (count(*) OVER (PARTITION BY arm, y_pred) - 1) / 2.0::DOUBLE AS b FROM p), sp AS (SELECT arm, corr(a, b) AS spearman FROM r GROUP BY arm),
m AS (SELECT arm, count(*) AS n, sqrt(avg((y_pred - y_true) ** 2)) AS pehe, avg(abs(y_pred - y_true)) AS mae, {", ".join(f"count(*) FILTER (bt <= ceil(round(n * {s}, 9)) AND bp <= ceil(round(n * {s}, 9))) / max(ceil(round(n * {s}, 9))) AS topk_{round(s * 100)}" for s in (0.1, 0.25))},
(sum(y_true * (n - bp + 0.5)) - max(n) * sum(y_true) / 2) / (sum(y_true * (n - bt + 0.5)) - max(n) * sum(y_true) / 2) AS qini FROM k GROUP BY arm)
SELECT arm, n, {", ".join(f"round({c}, 6) AS {c}" for c in ("pehe", "mae", "spearman", "topk_10", "topk_25", "qini"))} FROM m JOIN sp USING (arm)""",
    "gain_curve": f"{_P} SELECT arm, bp AS step, (sum(y_true::DECIMAL(18, 9)) OVER (PARTITION BY arm ORDER BY bp))::DOUBLE AS gain FROM k",
    "segment_errors": f"{_P} SELECT arm, c_mktsegment, count(*) AS n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS pehe, round(avg(y_pred - y_true), 6) AS bias FROM p JOIN customer ON pos = c_custkey GROUP BY ALL",
    "largest_errors": f"{_P} SELECT arm, pos, round(abs(round(y_pred, 9) - round(y_true, 9)), 9) AS error FROM p ORDER BY abs(round(y_pred, 9) - round(y_true, 9)) DESC, list_position({[f'delta_{a}' for a in OTHERS]}, arm), pos LIMIT 5",
    "card_differences": f"""{_P}, uc AS ({" UNION ALL ".join(f"SELECT arm, '{m}' AS metric, {e.format(f=' FILTER (fold < 3)')} AS l, {e.format(f='')} AS r FROM p GROUP BY arm" for m, e in (("pehe", "round(sqrt(avg((y_pred - y_true) ** 2){f}), 9)"), ("mae", "round(avg(abs(y_pred - y_true)){f}, 9)"), ("n", "count(*){f}::DOUBLE")))})
SELECT arm, metric, round(l, 6) AS "left", round(r, 6) AS "right" FROM uc WHERE abs(l - r) > 1e-3""",
    "model_choice": f"""{_P}, g AS (SELECT arm, fold, sum(y_true) AS s, count(*) AS c FROM p GROUP BY ALL), m AS (SELECT arm, fold, (sum(s) OVER (PARTITION BY arm) - s) / (sum(c) OVER (PARTITION BY arm) - c) AS m FROM g),
e AS (SELECT arm, round(sqrt(avg((m - y_true) ** 2)), 9) AS a, round(sqrt(avg((y_pred - y_true) ** 2)), 9) AS b FROM p JOIN m USING (arm, fold) GROUP BY arm) SELECT arm, CASE WHEN a <= b THEN 'constant' ELSE 'stand_in' END AS model, round(least(a, b), 6) AS pehe FROM e""",
    "score_histogram": "SELECT least(floor((score - 0.0) / 0.05::DOUBLE) + 1, 20)::BIGINT AS bin, count(*) AS n FROM planner_outcome WHERE score BETWEEN 0 AND 1 GROUP BY 1",
    "signed_rank": f"""{_P}, a AS (SELECT arm, abs(y_true) AS a, y_true > 0 AS up FROM p WHERE y_true <> 0),
r AS (SELECT arm, up, rank() OVER (PARTITION BY arm ORDER BY a) + (count(*) OVER (PARTITION BY arm, a) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY arm, a) AS t FROM a),
s AS (SELECT arm, count(*) AS n, sum(CASE WHEN up THEN r ELSE 0 END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY arm),
zs AS (SELECT arm, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM zs)
SELECT arm, n, round(w, 3) AS w_plus, round(z, 6) AS z, round(least(1.0::DOUBLE, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)), 6) AS p FROM t""",
    "constant_oof": f"""{_P}, g AS (SELECT arm, fold, sum(y_true) AS s, count(*) AS c FROM p GROUP BY ALL),
m AS (SELECT arm, fold, (sum(s) OVER (PARTITION BY arm) - s) / (sum(c) OVER (PARTITION BY arm) - c) AS m FROM g)
SELECT pos AS id, fold, arm AS target, round(y_true, 6) AS y_true, round(m, 6) AS y_pred FROM p JOIN m USING (arm, fold)""",
}
QUERIES = {f.__name__: f for f in (pehe_mae, spearman_avg_rank, topk_recall, qini, best_arm_per_fold, bootstrap_hash_ci, cluster_bootstrap, metric_bundle, gain_curve, segment_errors, largest_errors, card_differences, model_choice, variance_test, ridge_importance, score_histogram, signed_rank, constant_oof, ridge_oof)}
