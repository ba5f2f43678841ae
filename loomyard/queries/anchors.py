"""Time anchors (events per user): ordering, flags, funnels, tags, blocks and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flags as G
from ..operators import sampling as S
from ..operators.ranking import positions, ranked_by_hash
from ..sources.tables import micros, table

H = 3_600_000_000
SEED = 7


def anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("us", micros("ts")).drop("ts")
    return e.withColumn("start_us", F.col("us") - 3 * H).withColumn("end_us", F.col("us") + 12 * H).withColumn("city", F.concat(F.lit("city_"), (F.col("user_id") % 4).cast("string")))


def anchor_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rules as flags, no row dropped: inner position, window within the log (closed), value above the median type value."""
    a = anchors(spark, d)
    whole = a.groupBy("user_id").agg(F.count("*").alias("n"), F.min("us").alias("log_start"), F.max("us").alias("log_end"))
    a = positions(a, ["user_id"], [F.col("us"), F.col("event_id")], name="idx").join(whole, "user_id")
    a = a.withColumn("inner_ok", (F.col("idx") >= 3) & (F.col("idx") < F.col("n") - 1)).withColumn("window_ok", (F.col("start_us") >= F.col("log_start")) & (F.col("end_us") <= F.col("log_end")))
    a = a.withColumn("value_ok", F.coalesce(F.col("value") > 10, F.lit(False)))
    return G.all_of(a, ["inner_ok", "window_ok", "value_ok"], "ready").select("event_id", "user_id", "idx", "inner_ok", "window_ok", "value_ok", "ready")


def anchor_funnel(spark: SparkSession, d: str) -> DataFrame:
    f = anchor_flags(spark, d)
    return G.funnel(f, ["inner_ok", "window_ok", "value_ok"], ["user_id"])


def ready_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Kept and excluded by the conjunction of: ready, of a benchmark type, not of a user that shares the small sample."""
    a = anchors(spark, d).select("event_id", "event_type")
    f = anchor_flags(spark, d).join(a, "event_id").withColumn("typed", F.col("event_type").isin("click", "purchase")).withColumn("apart", F.col("user_id") % 10 != 0)
    return G.keep(G.all_of(f, ["ready", "typed", "apart"], "candidate"), "candidate")[1]


def flagged_users(spark: SparkSession, d: str) -> DataFrame:
    """Users with an event of value above 400 or with an early or late anchor, candidates or not."""
    f = anchors(spark, d).withColumn("high", F.col("value") > 400).withColumn("last", F.col("event_type") == "error")
    return G.keys_of_any(f.withColumn("rare", F.col("last") & (F.col("value") > 250)), "user_id", ["high", "rare"])


def order_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders against all customers: missing, extra, common."""
    o, c = table(spark, d, "orders", F.col("o_custkey").alias("k")), table(spark, d, "customer", F.col("c_custkey").alias("k"))
    return G.compare_sets(o, c, "k")


def anchor_tags(spark: SparkSession, d: str) -> DataFrame:
    """Per user and day the sorted distinct tags and the greatest allowed one (null if there is none)."""
    a = anchors(spark, d).withColumn("day", F.expr(f"us div {24 * H}"))
    g = a.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("t"))
    allowed = F.array(F.lit("click"), F.lit("purchase"))
    return g.select("user_id", "day", "n", F.array_join("t", "|").alias("tags"), F.array_max(F.array_intersect("t", allowed)).alias("label"))


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Explode, aggregate, keep groups of at least 5."""
    t = anchor_tags(spark, d).select("n", F.explode(F.split("tags", r"\|")).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n_days"), F.sum("n").alias("n_events")).where("n_days >= 5")


def type_by_city_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_mktsegment", "c_nationkey")
    nations = table(spark, d, "nation", "n_nationkey", "n_name")
    rows = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return S.complete_counts(rows, "n_name", "c_mktsegment", nations, c)


def time_blocks(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    block = F.expr(f"(us - first_us) div {15 * H}").cast("string")
    return a.join(a.groupBy("user_id").agg(F.min("us").alias("first_us")), "user_id").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.lpad(block, 5, "0")).alias("block_id"))


def shard_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Line items per order against the orders table, full outer: counts on either side and whether they agree."""
    li = table(spark, d, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
    o = table(spark, d, "orders", F.col("o_orderkey").alias("k")).groupBy("k").agg(F.count("*").alias("n_orders"))
    j = o.join(li, "k", "full_outer").select("k", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return j.groupBy((F.col("n_orders") > 0).alias("in_orders"), (F.col("n_lines") > 0).alias("in_lines")).agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines"))


def hash_rank_topn(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d).withColumn("rank_key", S.rank_key(SEED, "event_id"))
    return S.first_n(ranked_by_hash(a, ["event_type"], "rank_key", ["event_id"], name="group_rank"), 5).select("event_type", "event_id", "rank_key", "group_rank")


def user_split(spark: SparkSession, d: str) -> DataFrame:
    return S.group_split(anchors(spark, d), "city", "user_id", seed=SEED)


def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Events per city, type and split over the full domain, zero filled."""
    split = user_split(spark, d)
    a = anchors(spark, d)
    rows = a.join(split, ["city", "user_id"]).withColumn("cell", F.concat_ws("|", "city", "event_type"))
    return S.complete_counts(rows, "cell", "split", rows, split)


def log_folds(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_folds(anchors(spark, d), "user_id", "event_id", folds=5, seed=SEED)


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.fold_sizes(anchors(spark, d), log_folds(spark, d), "user_id", "fold")


def fold_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every row dealt to a fold by its own hash, not by its user: the users that stand in several folds."""
    a = anchors(spark, d).withColumn("fold", F.expr("cast(conv(substring(sha2(concat('leak:', event_id), 256), 1, 8), 16, 10) AS long) % 2"))
    return S.leaking_units(a, "user_id", "fold")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return S.greedy_ranking(anchors(spark, d), city="city", kind="event_type", scope="user_id", start="start_us", end="end_us", key="event_id", seed=SEED, bucket_width=240 * H)


def nonoverlap_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("city", "event_type", "user_id", "event_id", "group_size", "rank_key", "group_rank")


def nested_cut(spark: SparkSession, d: str) -> DataFrame:
    return S.first_n(_ranking(spark, d), 5).select("city", "event_type", "event_id", "group_rank")


def group_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """Per city and type, over the full domain: candidates, ranked, selected at 5 and 25, shortfalls."""
    a, r = anchors(spark, d), _ranking(spark, d)
    g = S.complete_counts(a, "city", "event_type", a, a).withColumnRenamed("n", "candidates")
    n = r.groupBy("city", "event_type").agg(F.count("*").alias("ranked"))
    out = g.join(n, ["city", "event_type"], "left").fillna(0)
    cuts = [c for k in (5, 25) for c in (F.least("ranked", F.lit(k)).alias(f"selected_{k}"), F.greatest(F.lit(0), k - F.col("ranked")).alias(f"shortfall_{k}"))]
    return out.select("city", "event_type", "candidates", "ranked", *cuts)


def overlap_violations(spark: SparkSession, d: str) -> DataFrame:
    return S.overlap_offenders(anchors(spark, d), "user_id", "start_us", "end_us", "event_id").select("event_id", "user_id")


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Stops at 5 per type, which claims fewer windows than cutting a full ranking; tested against brute force. A pilot: may fall short."""
    return S.quota_sample(anchors(spark, d), city="city", kind="event_type", scope="user_id", start="start_us", end="end_us", key="event_id", seed=SEED, quota=5, refuse=False).select("city", "event_type", "event_id", "rank_key")


_A = f"a AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, epoch_us(ts) - {3 * H} AS start_us, epoch_us(ts) + {12 * H} AS end_us, 'city_' || (user_id % 4) AS city FROM events)"
_F = f"""{_A}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS idx, count(*) OVER (PARTITION BY user_id) AS n,
min(us) OVER (PARTITION BY user_id) AS lo, max(us) OVER (PARTITION BY user_id) AS hi FROM a),
f AS (SELECT event_id, user_id, idx, idx >= 3 AND idx < n - 1 AS inner_ok, start_us >= lo AND end_us <= hi AS window_ok, coalesce(value > 10, false) AS value_ok FROM i)"""
_T = f"""{_A}, t AS (SELECT user_id, us // {24 * H} AS day, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS tags, max(event_type) FILTER (event_type IN ('click', 'purchase')) AS label FROM a GROUP BY ALL)"""
_SPLIT = f"""{_A}, u AS (SELECT DISTINCT city, user_id, sha256('{SEED}:split:' || user_id)[:16] AS h FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY h, user_id) AS place, count(*) OVER (PARTITION BY city) AS n FROM u),
k AS (SELECT *, greatest(1, round_even(n * 0.15, 0)::INT) AS v FROM r),
s AS (SELECT city, user_id, CASE WHEN place <= n - 2 * v THEN 'train' WHEN place <= n - v THEN 'validation' ELSE 'test' END AS split FROM k)"""
_FOLDS = f"""{_A}, z AS (SELECT user_id, count(DISTINCT event_id) AS size, row_number() OVER (ORDER BY count(DISTINCT event_id) DESC, sha256('{SEED}:' || user_id)[:16], user_id) AS i FROM a GROUP BY user_id),
f(i, user_id, size, fold, load) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::INT, [0, 0, 0, 0, 0]::BIGINT[]
UNION ALL SELECT z.i, z.user_id, z.size, (list_position(load, list_min(load)) - 1)::INT, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN z.size ELSE 0 END) FROM f JOIN z ON z.i = f.i + 1)"""
_RANK = f"""{_A}, g AS (SELECT *, count(*) OVER (PARTITION BY city, event_type) AS group_size, sha256('{SEED}:' || event_id)[:16] AS rank_key FROM a),
l AS (SELECT city, user_id, list([{{'id': event_id, 's': start_us, 'e': end_us}}] ORDER BY group_size, event_type, rank_key, event_id) AS xs FROM g GROUP BY ALL),
t AS (SELECT unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(acc, x) ELSE acc END)).id AS event_id FROM l),
k AS (SELECT city, event_type, user_id, event_id, group_size, rank_key, row_number() OVER (PARTITION BY city, event_type ORDER BY rank_key, event_id) AS group_rank FROM g JOIN t USING (event_id))"""
SQL = {
    "anchor_flags": f"WITH {_F} SELECT *, inner_ok AND window_ok AND value_ok AS ready FROM f",
    "anchor_funnel": f"""WITH {_F} SELECT 0 AS step, 'all' AS rule, count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id FROM f
UNION ALL SELECT 1, 'inner_ok', count(*), count(DISTINCT user_id) FROM f WHERE inner_ok
UNION ALL SELECT 2, 'window_ok', count(*), count(DISTINCT user_id) FROM f WHERE inner_ok AND window_ok
UNION ALL SELECT 3, 'value_ok', count(*), count(DISTINCT user_id) FROM f WHERE inner_ok AND window_ok AND value_ok""",
    "ready_candidates": f"""WITH {_F}, c AS (SELECT inner_ok AND window_ok AND value_ok AND a.event_type IN ('click', 'purchase') AND f.user_id % 10 <> 0 AS ok FROM f JOIN a USING (event_id)) SELECT count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT coalesce(ok, false)) AS n_excluded FROM c""",
    "flagged_users": f"WITH {_A} SELECT DISTINCT user_id FROM a WHERE value > 400 OR (event_type = 'error' AND value > 250)",
    "order_customers": "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_right, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS common",
    "anchor_tags": f"WITH {_T} SELECT * FROM t",
    "tag_counts": f"WITH {_T}, x AS (SELECT n, unnest(string_split(tags, '|')) AS tag FROM t) SELECT tag, count(*) AS n_days, sum(n)::BIGINT AS n_events FROM x GROUP BY tag HAVING count(*) >= 5",
    "type_by_city_counts": "SELECT n_name, s AS c_mktsegment, count(c_custkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = s GROUP BY ALL",
    "time_blocks": f"WITH {_A} SELECT event_id, user_id || ':' || lpad(((us - min(us) OVER (PARTITION BY user_id)) // {15 * H})::VARCHAR, 5, '0') AS block_id FROM a",
    "shard_reconcile": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(o.n, 0) > 0 AS in_orders, coalesce(l.n, 0) > 0 AS in_lines, count(*) AS n, sum(coalesce(l.n, 0))::BIGINT AS lines FROM o FULL JOIN l USING (k) GROUP BY ALL""",
    "hash_rank_topn": f"""WITH {_A}, r AS (SELECT event_type, event_id, sha256('{SEED}:' || event_id)[:16] AS rank_key FROM a)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rank_key, event_id) AS group_rank FROM r) WHERE group_rank <= 5""",
    "log_folds": f"""WITH RECURSIVE {_FOLDS} SELECT user_id, size, fold FROM f WHERE i > 0""",
    "fold_sizes": f"""WITH RECURSIVE {_FOLDS} SELECT fold, sum(size)::BIGINT AS n_test, (SELECT count(*) FROM a) - sum(size)::BIGINT AS n_train FROM f WHERE i > 0 GROUP BY fold""",
    "fold_leaks": f"""WITH {_A}, x AS (SELECT user_id, ('0x' || sha256('leak:' || event_id)[:8])::BIGINT % 2 AS fold FROM a)
SELECT user_id, string_agg(DISTINCT fold::VARCHAR, '|' ORDER BY fold::VARCHAR) AS splits FROM x GROUP BY 1 HAVING count(DISTINCT fold) > 1""",
    "user_split": f"WITH {_SPLIT} SELECT * FROM s",
    "split_coverage": f"""WITH {_SPLIT}, x AS (SELECT city || '|' || event_type AS cell, split FROM a JOIN s USING (city, user_id)),
d AS (SELECT * FROM (SELECT DISTINCT cell FROM x), (SELECT DISTINCT split FROM s)) SELECT d.cell, d.split, count(x.cell) AS n FROM d LEFT JOIN x ON x.cell = d.cell AND x.split = d.split GROUP BY ALL""",
    "nonoverlap_ranking": f"WITH {_RANK} SELECT city, event_type, user_id, event_id, group_size, rank_key, group_rank FROM k",
    "nested_cut": f"WITH {_RANK} SELECT city, event_type, event_id, group_rank FROM k WHERE group_rank <= 5",
    "group_shortfall": f"""WITH {_RANK}, d AS (SELECT * FROM (SELECT DISTINCT city FROM a), (SELECT DISTINCT event_type FROM a)),
n AS (SELECT city, event_type, count(*) AS n FROM k GROUP BY ALL), c AS (SELECT city, event_type, count(*) AS n FROM a GROUP BY ALL),
z AS (SELECT d.city, d.event_type, coalesce(c.n, 0) AS candidates, coalesce(n.n, 0) AS ranked FROM d LEFT JOIN c USING (city, event_type) LEFT JOIN n USING (city, event_type))
SELECT *, least(ranked, 5) AS selected_5, greatest(0, 5 - ranked) AS shortfall_5, least(ranked, 25) AS selected_25, greatest(0, 25 - ranked) AS shortfall_25 FROM z""",
    "overlap_violations": f"""WITH {_A} SELECT event_id, user_id FROM (SELECT *, max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM a) WHERE start_us < r""",
}
QUERIES = {f.__name__: f for f in (anchor_flags, anchor_funnel, ready_candidates, flagged_users, order_customers, anchor_tags, tag_counts, type_by_city_counts, time_blocks, shard_reconcile, hash_rank_topn, user_split, split_coverage, log_folds, fold_sizes, fold_leaks, nonoverlap_ranking, nested_cut, group_shortfall, overlap_violations, quota_sample)}
