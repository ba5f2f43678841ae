"""As-of joins, hourly grids, rolling sums, gaps, sun position, spatial and neighbour queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial as X
from ..operators import temporal as T
from ..operators.asof import asof_backward
from ..operators.assembly import join_many_to_one
from ..sources.tables import table
from .anchors import _A, H, anchors

# Literal polygons over (p_size, p_retailprice); points often lie on their edges.
POLYGONS = [(1, [(1, 900), (20, 900), (20, 950), (1, 950)]), (2, [(10, 920), (40, 930), (30, 990), (12, 980)]), (3, [(25, 905), (50, 905), (50, 1000), (38, 950)])]


def asof_first_after(spark: SparkSession, d: str) -> DataFrame:
    """The first purchase of the user at or after each event less 3 hours; none gives null."""
    a = anchors(spark, d)
    buys = a.where("event_type = 'purchase'").groupBy("user_id", "us").agg(F.min("event_id").alias("buy_id"))
    out = T.asof_forward(a.select("event_id", "user_id", "start_us"), buys, "user_id", "start_us", "us", ["us", "buy_id"], bucket_width=240 * H)
    return out.select("event_id", "next_us", "next_buy_id")


def asof_last_before(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    buys = a.where("event_type = 'purchase'").groupBy("user_id", "us").agg(F.min("event_id").alias("buy_id"))
    return asof_backward(a.select("event_id", "user_id", "us"), buys, "user_id", "us", "us", ["buy_id"], bucket_width=240 * H).select("event_id", "asof_buy_id")


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).groupBy(T.grid_floor("us", H).alias("hour_us")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def hourly_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the series value of its own hour: never a later one."""
    a = anchors(spark, d).withColumn("hour_us", T.grid_floor("us", H))
    return a.join(_hourly(spark, d), "hour_us", "left").select("event_id", "hour_us", "n", "total")


def rolling_3h(spark: SparkSession, d: str) -> DataFrame:
    out = T.rolling_sum(_hourly(spark, d), [], "hour_us", "total", 3, "sum_3h")
    return out.select("hour_us", F.round("sum_3h", 3).alias("sum_3h"))


def gap_check(spark: SparkSession, d: str) -> DataFrame:
    g = T.gaps(anchors(spark, d), "user_id", "us", "event_id").where("gap is not null")
    return g.groupBy("user_id").agg(F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count(F.when(F.col("gap") > 24 * H, 1)).alias("n_over_day"))


def modulo_subsample(spark: SparkSession, d: str) -> DataFrame:
    return T.every_kth(anchors(spark, d), "user_id", ["us", "event_id"], 7).select("event_id", "user_id")


def sun_elevation(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    return a.select("event_id", F.round(T.sun_elevation(F.col("us"), F.lit(40.44), F.lit(-79.99)), 3).alias("elevation"))


def series_profile(spark: SparkSession, d: str) -> DataFrame:
    """Size, median, 90th percentile and null count per type, exact."""
    a = anchors(spark, d)
    return a.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 2).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 2).alias("p90"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    return X.points_in_polygons(p, X.polygon_edges(POLYGONS, spark), key="p_partkey", x="p_size", y="p_retailprice", cell=25.0)


def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    """The line items of an order around it, placed by key arithmetic."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    frames = o.select("o_orderkey", (F.col("o_orderkey") % 97).cast("double").alias("ex"), (F.col("o_custkey") % 89).cast("double").alias("ey"))
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    objects = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_partkey") * 7 % 97).cast("double").alias("ox"), (F.col("l_suppkey") * 5 % 89).cast("double").alias("oy"))
    return X.neighbours(frames, objects, "o_orderkey", object_id="l_linenumber", radius=20.0).withColumn("nearest_distance", F.round("nearest_distance", 6))


def closing_speed(spark: SparkSession, d: str) -> DataFrame:
    """Heading and closing speed towards the origin of every pose."""
    p = table(spark, d, "ego_pose", "pose_id", "x", "y", "qw", "qz", "vx", "vy")
    return p.select("pose_id", F.round(X.yaw(F.col("qw"), F.col("qz")), 6).alias("yaw"), F.round(X.closing_speed(F.col("x"), F.col("y"), F.col("vx"), F.col("vy")), 6).alias("closing"))


def pose_global(spark: SparkSession, d: str) -> DataFrame:
    """Centre and velocity of every pose in the global frame."""
    p = table(spark, d, "ego_pose", "pose_id", "x", "y", "qw", "qz", "vx", "vy")
    h = X.yaw(F.col("qw"), F.col("qz"))
    (cx, cy), (gx, gy) = X.centre_of(F.col("x"), F.col("y"), h, 1.461), X.to_global(F.col("vx"), F.col("vy"), h)
    return p.select("pose_id", *[F.round(c, 6).alias(n) for n, c in (("cx", cx), ("cy", cy), ("gx", gx), ("gy", gy))])


def place_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every customer from the first place of its nation, on degrees made from keys."""
    lat, lon = 40 + F.col("c_custkey") % 97 / 1000, -80 + F.col("c_custkey") % 89 / 1000
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", "c_nationkey", lat.alias("lat"), lon.alias("lon"))
    first = c.groupBy("c_nationkey").agg(F.min_by("lat", "c_custkey").alias("lat0"), F.min_by("lon", "c_custkey").alias("lon0"))
    return c.join(first, "c_nationkey").select("c_custkey", F.round(X.degree_distance_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 6).alias("km"))


def user_hour_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's total of the hour before: many to one on (user, hour)."""
    a = anchors(spark, d).withColumn("hour_us", T.grid_floor("us", H))
    per = a.groupBy("user_id", (F.col("hour_us") + H).alias("hour_us")).agg(F.round(F.sum("value"), 6).alias("total_before"))
    return join_many_to_one(a, per, ["user_id", "hour_us"]).select("event_id", "total_before")


def map_features(spark: SparkSession, d: str) -> DataFrame:
    """Parts as places on two layers, with the states of their line items; some have no place and some no token."""
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumn("p_size", F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")))
    hit = lambda polygons: X.points_in_polygons(p, X.polygon_edges(polygons, spark), key="p_partkey", x="p_size", y="p_retailprice", cell=25.0)
    lights = table(spark, d, "lineitem", F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("state")).where("p_partkey % 5 <> 0")
    return X.map_features(p.select("p_partkey", "p_size"), {"lane": hit(POLYGONS[:2]), "connector": hit(POLYGONS[2:])}, lights, key="p_partkey", located=F.col("p_size").isNotNull(), tokened=F.col("p_partkey") % 17 != 0, order=["R", "A"]).drop("p_size")


def adjacency_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Orders' own parts of even key, else the parts of their suppliers' list."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    src = li.select("l_orderkey", F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("own"), "l_suppkey")
    edges = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("link"))
    return X.adjacency(src, edges, key="l_orderkey", own="own", via="l_suppkey").select("l_orderkey", F.array_join("links", "|").alias("links"))


def priority_state(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag")
    return X.strongest(li, "l_orderkey", "l_returnflag", ["R", "A"])


_HOURLY = f"{_A}, h AS (SELECT us // {H} * {H} AS hour_us, count(*) AS n, round(sum(value), 6) AS total FROM a GROUP BY 1)"
_BUY = f"{_A}, b AS (SELECT user_id, us, min(event_id) AS id FROM a WHERE event_type = 'purchase' GROUP BY ALL)"
_POLY = ", ".join(f"({i}, {float(p[0])}, {float(p[1])}, {float(q[0])}, {float(q[1])})" for i, r in POLYGONS for p, q in zip(r, [*r[1:], r[0]]))
_SUN = """WITH p AS (SELECT event_id, epoch_us(ts) AS us, 40.44::DOUBLE AS lat, -79.99::DOUBLE AS lon FROM events),
t AS (SELECT *, (us / 86400000000.0::DOUBLE - 10957.5) / 36525.0 AS t FROM p),
a AS (SELECT *, (280.46646 + t * (36000.76983 + t * 0.0003032)) AS l_raw, 357.52911 + t * (35999.05029 - 0.0001537 * t) AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS om FROM t),
b AS (SELECT *, l_raw - 360 * floor(l_raw / 360) AS l0 FROM a),
c AS (SELECT *, l0 + sin(radians(m)) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(radians(2 * m)) * (0.019993 - 0.000101 * t) + sin(radians(3 * m)) * 0.000289 - 0.00569 - 0.00478 * sin(om) AS app,
radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) AS tilt FROM b),
d AS (SELECT *, asin(sin(tilt) * sin(radians(app))) AS decl, pow(tan(tilt / 2), 2) AS y, radians(m) AS mr, radians(l0) AS lr FROM c),
f AS (SELECT *, 4 * degrees(y * sin(2 * lr) - 2 * e * sin(mr) + 4 * e * y * sin(mr) * cos(2 * lr) - 0.5 * y * y * sin(4 * lr) - 1.25 * e * e * sin(2 * mr)) AS eot FROM d),
g AS (SELECT *, (us % 86400000000) / 60000000.0::DOUBLE + eot + 4 * lon AS mr0 FROM f),
h AS (SELECT *, radians((mr0 - 1440 * floor(mr0 / 1440)) / 4 - 180) AS ang FROM g)
SELECT event_id, round(degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(ang))))), 3) AS elevation FROM h"""
SQL = {
    "asof_first_after": f"WITH {_BUY} SELECT event_id, b.us AS next_us, b.id AS next_buy_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.start_us <= b.us",
    "asof_last_before": f"WITH {_BUY} SELECT event_id, b.id AS asof_buy_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.us",
    "hourly_asof": f"WITH {_HOURLY} SELECT event_id, hour_us, n, total FROM a LEFT JOIN h ON h.hour_us = a.us // {H} * {H}",
    "rolling_3h": f"WITH {_HOURLY} SELECT hour_us, CASE WHEN count(*) OVER w = 3 THEN round(sum(total) OVER w, 3) END AS sum_3h FROM h WINDOW w AS (ORDER BY hour_us ROWS 2 PRECEDING)",
    "gap_check": f"WITH {_A}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM a) SELECT user_id, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap, count(*) FILTER (gap > {24 * H}) AS n_over_day FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "modulo_subsample": f"WITH {_A} SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM a) WHERE (n - 1) % 7 = 0",
    "sun_elevation": _SUN,
    "series_profile": "SELECT event_type, count(*) AS n, round(median(value), 2) AS median, round(quantile_cont(value, 0.9), 2) AS p90, count(*) FILTER (value IS NULL) AS n_null FROM events GROUP BY 1",
    "point_in_polygon": f"""WITH e(polygon_id, x1, y1, x2, y2) AS (VALUES {_POLY}), j AS (SELECT p_partkey, polygon_id, p_size::DOUBLE AS px, p_retailprice AS py, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM part, e)
SELECT p_partkey, polygon_id::BIGINT AS polygon_id FROM j GROUP BY ALL HAVING bool_or((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2))
OR count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""",
    "nearest_neighbour": """WITH j AS (SELECT o_orderkey, l_linenumber, sqrt((l_partkey * 7 % 97 - o_orderkey % 97) ** 2 + (l_suppkey * 5 % 89 - o_custkey % 89) ** 2) AS dist FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) FILTER (dist <= 20) AS n_near, round(min(dist), 6) AS nearest_distance, arg_min(l_linenumber, (dist, l_linenumber)) AS nearest_id FROM j GROUP BY 1""",
    "pose_global": """WITH h AS (SELECT *, atan2(2 * qw * qz, 1 - 2 * qz * qz) AS h FROM ego_pose)
SELECT pose_id, round(x + 1.461 * cos(h), 6) AS cx, round(y + 1.461 * sin(h), 6) AS cy, round(vx * cos(h) - vy * sin(h), 6) AS gx, round(vx * sin(h) + vy * cos(h), 6) AS gy FROM h""",
    "place_distances": """WITH c AS (SELECT c_custkey, c_nationkey, 40 + c_custkey % 97 / 1000.0::DOUBLE AS lat, -80 + c_custkey % 89 / 1000.0::DOUBLE AS lon FROM customer), f AS (SELECT c_nationkey, arg_min(lat, c_custkey) AS lat0, arg_min(lon, c_custkey) AS lon0 FROM c GROUP BY 1)
SELECT c_custkey, round(sqrt((lat - lat0) ** 2 + ((lon - lon0) * cos(radians((lat0 + lat) / 2))) ** 2) * 111.2, 6) AS km FROM c JOIN f USING (c_nationkey)""",
    "user_hour_totals": f"WITH {_A}, h AS (SELECT *, us // {H} * {H} AS hr FROM a), t AS (SELECT user_id, hr + {H} AS hr, round(sum(value), 6) AS total_before FROM h GROUP BY ALL) SELECT event_id, total_before FROM h LEFT JOIN t USING (user_id, hr)",
    "map_features": f"""WITH e(polygon_id, x1, y1, x2, y2) AS (VALUES {_POLY}), j AS (SELECT p_partkey, polygon_id, p_size::DOUBLE AS px, p_retailprice AS py, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM part, e WHERE p_partkey % 13 <> 0),
h AS (SELECT p_partkey, polygon_id FROM j GROUP BY ALL HAVING bool_or((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) OR count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1),
g AS (SELECT p_partkey, string_agg(polygon_id::VARCHAR, '|' ORDER BY polygon_id) FILTER (polygon_id < 3) AS lane, string_agg(polygon_id::VARCHAR, '|' ORDER BY polygon_id) FILTER (polygon_id = 3) AS conn FROM h GROUP BY 1),
s AS (SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'unknown' END AS light FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
SELECT p.p_partkey, CASE WHEN ok THEN coalesce(lane, '') END AS lane_ids, CASE WHEN ok THEN coalesce(conn, '') END AS connector_ids, CASE WHEN NOT ok THEN NULL WHEN lane <> '' THEN 'lane' WHEN conn <> '' THEN 'connector' ELSE 'off the map' END AS place,
CASE WHEN ok AND p.p_partkey % 17 <> 0 THEN light END AS light FROM (SELECT p_partkey, p_partkey % 13 <> 0 AND p_size IS NOT NULL AS ok FROM part) AS p LEFT JOIN g USING (p_partkey) LEFT JOIN s ON l_partkey = p.p_partkey""",
    "closing_speed": "SELECT pose_id, round(atan2(2 * qw * qz + 0.0, 1 - 2 * qz * qz), 6) AS yaw, round(-(x * vx + y * vy) / nullif(sqrt(x * x + y * y), 0), 6) AS closing FROM ego_pose",
    "adjacency_fallback": """WITH m AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0)) AS own, list_sort(list(DISTINCT s_nationkey::BIGINT)) AS far FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT l_orderkey, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE far END, '|') AS links FROM m""",
    "priority_state": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'unknown' END AS state FROM lineitem GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (asof_first_after, asof_last_before, hourly_asof, rolling_3h, gap_check, modulo_subsample, sun_elevation, series_profile, point_in_polygon, nearest_neighbour, closing_speed, pose_global, place_distances, user_hour_totals, map_features, adjacency_fallback, priority_state)}
