"""Queries of the training-data problems, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..queries.problems import _WS
from ..sources.tables import table
from . import leakage, mixing, nearest, residue, splits, stable_sample, target_sample

TOLERANCE_US = 100_000
LINKS = ["scenario_id", "log_name", "source_recording"]
RATE, SALT = 0.2, "stable-2024"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenario_sample", "row_id", "log_name", "anchor_timestamp_us", "window_start_us")
    instants = F.array(F.struct(F.lit("anchor").alias("instant"), F.col("anchor_timestamp_us").alias("at")), F.struct(F.lit("window_start").alias("instant"), F.col("window_start_us").alias("at")))
    left = rows.select("row_id", norm_key("log_name").alias("log"), F.explode(instants).alias("i")).select("row_id", "log", "i.instant", "i.at")
    poses = table(spark, d, "ego_pose", "pose_id", "log_name", "timestamp_us").withColumn("log", norm_key("log_name"))
    out = nearest.nearest_in_time(left, poses, entity="log", left_time="at", right_time="timestamp_us", right_id="pose_id", tolerance=TOLERANCE_US, bucket_width=60_000_000)
    return out.select("row_id", "instant", "pose_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenario_sample", *LINKS)
    return splits.together(rows, LINKS, "source_recording").select(F.col("a").alias("recording_a"), F.col("b").alias("recording_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Membership: each recording with the least one that must share its split."""
    out = splits.groups(table(spark, d, "scenario_sample", *LINKS), LINKS, "source_recording")
    return out.select(F.col("value").alias("source_recording"), F.col("group").alias("group_recording"))


def p3_forest(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, components and edges of the spanning forest: as many edges as nodes less components, none twice."""
    f = splits.spanning_forest(*splits.shared_key_edges(table(spark, d, "scenario_sample", *LINKS), LINKS))
    n = f.members.agg(F.count("*").alias("nodes"), F.countDistinct("root").alias("components"))
    e = f.edges.agg(F.count("*").alias("forest_edges"), F.countDistinct("a", "b").alias("different_edges"))
    return n.crossJoin(e)  # one row each


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenario_sample", "row_id", *LINKS)
    return splits.split_rows(rows, LINKS, "row_id").select("row_id", "split")


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "scenario_sample", "source_city", "scenario_type", "scenario_id")
    return target_sample.target_sample(rows, table(spark, d, "sample_target"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    report = _p5(spark, d)[1].where("exhausted").select("source_city", "scenario_type", F.lit("target").alias("check_name"))
    return report.unionByName(target_sample.noted_shortfalls(table(spark, d, "ranked_group")).withColumn("check_name", F.lit("shortfall")))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d)[0]


def p6_selected(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenario_sample", "row_id", "scenario_id", "source_city", "scenario_type", "ingested_at")
    return stable_sample.stable_sample_ordered(rows, "scenario_id", city="source_city", kind="scenario_type", at="ingested_at", tie="row_id", rate=RATE, salt=SALT)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "text"), doc_id="doc_id", item_id="item_id")


def _mixture(spark: SparkSession, d: str, **how: bool) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_target"), **how)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p9_records(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).records()


def p9_held(spark: SparkSession, d: str) -> DataFrame:
    """The greatest mixture in which every source has its share."""
    return _mixture(spark, d, hold_shares=True).shares()


def p9_words_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same mixture in words, which SQL can count."""
    return _mixture(spark, d, words=True).shares()


def p9_words_records(spark: SparkSession, d: str) -> DataFrame:
    """Its records; the shard, drawn by numpy's hypergeometric generator, is left to the tests."""
    return _mixture(spark, d, words=True).records().drop("shard")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_records(spark, d).select("doc_id")


def p10_records(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text"))


_CAT = "nullif(translate(lower(trim({c}, " + _WS + ")), ' -', '__'), '')"
_CITY, _TYPE = _CAT.format(c="source_city"), _CAT.format(c="scenario_type")
_MIX = f"""WITH t AS (SELECT doc_id AS id, {_CAT.format(c="source")} AS s, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+')), 0) AS n FROM documents),
a AS (SELECT sum(n)::BIGINT AS n FROM t), g AS (SELECT s, count(*) AS docs, sum(n)::BIGINT AS n FROM t GROUP BY s),
w AS (SELECT {_CAT.format(c="source")} AS s, max(target_permille) AS p, max(max_repeats) AS r FROM mix_target WHERE {_CAT.format(c="source")} IS NOT NULL GROUP BY ALL),
p AS (SELECT w.s, p, r, coalesce(docs, 0) AS docs, coalesce(g.n, 0) AS n, p * a.n / 1000.0::DOUBLE AS wanted, (coalesce(g.n, 0) + 4095) // 4096 AS cells, a.n AS whole FROM w LEFT JOIN g ON g.s = w.s, a),
d AS (SELECT id, t.s, t.n, ('0x' || sha256('block-17:' || id)[:15])::BIGINT % cells AS block FROM t JOIN p ON t.s = p.s WHERE cells > 0),
b AS (SELECT s, block, sum(n)::BIGINT AS bn FROM d GROUP BY ALL), k AS (SELECT s, count(*) AS blocks FROM b GROUP BY s),
q AS (SELECT p.*, coalesce(blocks, 0) AS blocks, CASE WHEN n > 0 THEN least(r * blocks, floor(wanted / n * blocks + 0.5)::BIGINT) ELSE 0 END AS draws FROM p LEFT JOIN k ON k.s = p.s),
c AS (SELECT s, draws, blocks, unnest(range(0, (draws - 1) // blocks + 1)) AS copy FROM q WHERE draws > 0),
o AS (SELECT c.*, block, bn, row_number() OVER (PARTITION BY c.s, copy ORDER BY sha256('pass-17:' || c.s || ':' || copy || ':' || block)[:16], block) AS nth FROM c JOIN b ON b.s = c.s),
e AS (SELECT * FROM o WHERE nth + copy * blocks <= draws)"""
# The closure over all nodes; rounds carry the least label on, to the end of every component.
_LINK = f"""WITH RECURSIVE s AS (SELECT DISTINCT 's|' || lower(trim(scenario_id, {_WS})) AS a, 'l|' || lower(trim(log_name, {_WS})) AS b, 'r|' || lower(trim(source_recording, {_WS})) AS c FROM scenario_sample),
n AS (SELECT a AS x FROM s UNION SELECT b FROM s UNION SELECT c FROM s),
e AS (SELECT a AS x, b AS y FROM s UNION SELECT b, c FROM s UNION SELECT a, c FROM s),
g AS (SELECT x, y FROM e WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
t(x, l) USING KEY (x) AS (SELECT x, x FROM n WHERE x IS NOT NULL UNION
SELECT g.y, min(t.l) FROM t JOIN g ON g.x = t.x JOIN recurring.t AS o ON o.x = g.y WHERE t.l < o.l GROUP BY g.y),
r AS (SELECT substr(x, 3) AS v, l FROM t WHERE x LIKE 'r|%')"""
SQL = {
    "p3_found": f"{_LINK} SELECT a.v AS recording_a, b.v AS recording_b FROM r AS a JOIN r AS b ON a.l = b.l AND a.v < b.v",
    "p3_groups": f"{_LINK} SELECT v AS source_recording, min(v) OVER (PARTITION BY l) AS group_recording FROM r",
    "p3_forest": f"{_LINK} SELECT count(*) AS nodes, count(DISTINCT l) AS components, count(*) - count(DISTINCT l) AS forest_edges, count(*) - count(DISTINCT l) AS different_edges FROM t",
    "p9_words_shares": f"""{_MIX}, f AS (SELECT s, sum(bn)::BIGINT AS dn, count(*) AS db, max(copy) + 1 AS mc FROM e GROUP BY s),
x AS (SELECT q.*, coalesce(dn, 0) AS dn, coalesce(db, 0) AS db, coalesce(mc, 0) AS mc FROM q LEFT JOIN f ON f.s = q.s)
SELECT s AS source, p AS target_permille, r AS max_repeats, docs, n AS tokens, wanted AS wanted_tokens, blocks, draws, dn AS drawn_tokens, db AS drawn_blocks, mc AS most_copies,
round(dn * 1000 / sum(dn) OVER (), 3) AS reached_permille, round(dn * 1000 / whole, 3) AS of_all_permille, db >= r * blocks AND dn * 1000 < p * whole AS short FROM x""",
    "p9_words_records": f"""{_MIX} SELECT id AS doc_id, d.s AS source, copy, sha256('shuffle-17:' || id || ':' || copy)[:16] AS place_key FROM d JOIN e ON e.s = d.s AND e.block = d.block""",
    "p2_found": f"""
WITH l AS (SELECT row_id, lower(trim(log_name, {_WS})) AS log, anchor_timestamp_us AS a, window_start_us AS w FROM scenario_sample),
i AS (SELECT row_id, log, 'anchor' AS instant, a AS at_us FROM l UNION ALL SELECT row_id, log, 'window_start', w FROM l),
p AS (SELECT pose_id, lower(trim(log_name, {_WS})) AS log, timestamp_us AS t FROM ego_pose),
m AS (SELECT i.*, p.pose_id, row_number() OVER (PARTITION BY row_id, instant ORDER BY abs(t - at_us), t, pose_id) AS n
FROM i JOIN p ON p.log = i.log AND abs(t - at_us) <= {TOLERANCE_US})
SELECT row_id, instant, pose_id FROM m WHERE n = 1""",
    "p5_found": f"""
WITH s AS (SELECT {_CITY} AS c, {_TYPE} AS t, lower(trim(scenario_id, {_WS})) AS id FROM scenario_sample),
k AS (SELECT * FROM s WHERE c IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL),
n AS (SELECT count(DISTINCT id) // 5 AS s FROM k),
g AS (SELECT c, t, count(DISTINCT id) AS n FROM k GROUP BY c, t),
w AS (SELECT {_CITY} AS c, {_TYPE} AS t, max(target_permille) AS p, max(min_rows) AS m FROM sample_target GROUP BY ALL)
SELECT w.c AS source_city, w.t AS scenario_type, 'target' AS check_name FROM w LEFT JOIN g USING (c, t), n WHERE coalesce(g.n, 0) < greatest(m, (n.s * p + 500) // 1000)
UNION ALL SELECT DISTINCT {_CITY}, {_TYPE}, 'shortfall' FROM ranked_group
WHERE cuts['5'].shortfall IS NULL OR cuts['5'].shortfall <> greatest(0, 5 - ranked)""",
    "p5_sample": f"""
WITH s AS (SELECT DISTINCT {_CITY} AS c, {_TYPE} AS t, lower(trim(scenario_id, {_WS})) AS id FROM scenario_sample),
k AS (SELECT * FROM s WHERE c IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL),
n AS (SELECT count(DISTINCT id) // 5 AS s FROM k),
w AS (SELECT {_CITY} AS c, {_TYPE} AS t, max(target_permille) AS p, max(min_rows) AS m FROM sample_target GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY sha256('target-sample:' || id)[:16], id) AS rank FROM k)
SELECT c AS source_city, t AS scenario_type, id AS scenario_id, rank FROM r JOIN w USING (c, t), n WHERE rank <= greatest(m, (n.s * p + 500) // 1000)""",
    # Words instead of tokens: the sources found are the same for any usual way of counting.
    "p9_found": f"""
WITH t AS (SELECT {_CAT.format(c="source")} AS s, coalesce(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')), 0) AS n FROM documents),
g AS (SELECT s, sum(n) AS n FROM t GROUP BY s), a AS (SELECT sum(n) AS n FROM t),
w AS (SELECT {_CAT.format(c="source")} AS s, max(target_permille) AS p, max(max_repeats) AS r FROM mix_target GROUP BY ALL)
SELECT s AS source FROM w LEFT JOIN g USING (s), a WHERE r * coalesce(g.n, 0) * 1000 < p * a.n""",
    "p6_selected": f"""
WITH s AS (SELECT lower(trim(scenario_id, {_WS})) AS id, {_CITY} AS c, {_TYPE} AS t, ingested_at, row_id FROM scenario_sample WHERE scenario_id IS NOT NULL),
f AS (SELECT id, c, t, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS LAST, row_id) AS n FROM s),
h AS (SELECT id, c, t, sha256('{SALT}:' || id)[:16] AS key_hash FROM f WHERE n = 1),
k AS (SELECT * FROM h WHERE ('0x' || key_hash[:8])::BIGINT < {round(RATE * 2**32)})
SELECT id AS scenario_id, c AS source_city, t AS scenario_type, key_hash, row_number() OVER (PARTITION BY c, t ORDER BY key_hash, id) AS ranked FROM k""",
}
QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p3_forest": p3_forest, "p3_split": p3_split, "p5_found": p5_found, "p5_sample": p5_sample, "p6_selected": p6_selected, "p8_found": p8_found, "p8_passages": p8_passages, "p9_found": p9_found, "p9_shares": p9_shares, "p9_records": p9_records, "p9_held": p9_held, "p9_words_shares": p9_words_shares, "p9_words_records": p9_words_records, "p10_found": p10_found, "p10_records": p10_records}
