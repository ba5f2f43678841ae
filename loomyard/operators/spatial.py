"""Point in polygon, neighbours, adjacency with fallback, priority resolution, planar kinematics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def polygon_edges(polygons: list[tuple[int, list[tuple[float, float]]]], spark) -> DataFrame:
    """(polygon_id, x1, y1, x2, y2), one row per edge of a ring; the last point joins the first."""
    rows = [(i, *map(float, p), *map(float, q)) for i, ring in polygons for p, q in zip(ring, [*ring[1:], ring[0]])]
    return spark.createDataFrame(rows, "polygon_id long, x1 double, y1 double, x2 double, y2 double")


def points_in_polygons(points: DataFrame, edges: DataFrame, *, key: str, x: str, y: str, cell: float) -> DataFrame:
    """(key, polygon_id) of all hits; a point on the boundary is inside.

    Both sides are put into square cells: a polygon into the cells of its bounding box, a point into its own; the join
    is an equi-join on cells, then ray casting over the polygon's edges with an explicit on-edge test. Null or NaN
    coordinates hit nothing.
    """
    box = edges.groupBy("polygon_id").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    at = lambda c: F.floor(F.col(c) / cell)
    cells = box.select("*", F.explode(F.sequence(at("x0"), at("x9"))).alias("cx")).select("*", F.explode(F.sequence(at("y0"), at("y9"))).alias("cy"))
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y))).select(F.col(key), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    p = p.withColumn("cx", at("px")).withColumn("cy", at("py"))
    j = p.join(broadcast_if_small(cells, 50_000), ["cx", "cy"]).where("px between x0 and x9 and py between y0 and y9")
    px, py = F.col("px"), F.col("py")
    cross = lambda e: (e.x2 - e.x1) * (py - e.y1) - (e.y2 - e.y1) * (px - e.x1)
    on_edge = F.exists("edges", lambda e: (cross(e) == 0) & px.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & py.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)))
    crossed = F.size(F.filter("edges", lambda e: ((e.y1 > py) != (e.y2 > py)) & (px < (e.x2 - e.x1) * F.try_divide(py - e.y1, e.y2 - e.y1) + e.x1)))
    return j.where(on_edge | (crossed % 2 == 1)).select(key, "polygon_id")


def neighbours(frames: DataFrame, objects: DataFrame, frame: str, *, object_id: str, radius: float) -> DataFrame:
    """Per frame: objects within the radius (inclusive), the nearest object's distance and id; ties by id.

    frames: (frame, ex, ey); objects: (frame, object_id, ox, oy). Frames without objects have count 0 and null nearest.
    Both aggregates combine before the shuffle.
    """
    dist = F.hypot(F.col("ox") - F.col("ex"), F.col("oy") - F.col("ey"))
    j = frames.join(objects, frame, "left").withColumn("dist", dist)
    best = F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", object_id)))
    return j.groupBy(frame).agg(F.count(F.when(F.col("dist") <= radius, 1)).alias("n_near"), best.alias("b")).select(frame, "n_near", F.col("b.dist").alias("nearest_distance"), F.col(f"b.{object_id}").alias("nearest_id"))


def closing_speed(dx: Column, dy: Column, dvx: Column, dvy: Column) -> Column:
    """-(d . v) / |d|; null at distance 0."""
    return F.try_divide(-(dx * dvx + dy * dvy), F.hypot(dx, dy))


def yaw(qw: Column, qz: Column) -> Column:
    """Heading of a rotation about the vertical axis."""
    return F.atan2(2 * qw * qz, 1 - 2 * qz * qz)


def centre_of(x: Column, y: Column, heading: Column, offset: float) -> tuple[Column, Column]:
    """The centre of a body from its reference point, which lies `offset` behind it along the heading."""
    return x + offset * F.cos(heading), y + offset * F.sin(heading)


def to_global(vx: Column, vy: Column, heading: Column) -> tuple[Column, Column]:
    """A vector of the body's own frame in the global one."""
    return vx * F.cos(heading) - vy * F.sin(heading), vx * F.sin(heading) + vy * F.cos(heading)


def degree_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of places near each other: degrees on a plane whose longitudes shrink with the latitude, 111.2 km each."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(lat2 - lat1, dx) * 111.2


def map_features(frame: DataFrame, layers: dict[str, DataFrame], lights: DataFrame, *, key: str, located: Column, tokened: Column, order: list[str]) -> DataFrame:
    """Per row of the frame what the map layers and the signals say of it.

    layers: hits (key, polygon_id) per layer, as points_in_polygons gives them; lights: (key, state). Gives <layer>_ids
    (sorted, joined by '|', '' for no hit), place (the first layer that is hit, 'off the map' for none) and light (the
    strongest state). Precedence of nulls: without a location everything is null; without a token, or without any
    state, only the light is.
    """
    out = frame.withColumn("__loc", F.coalesce(located, F.lit(False))).withColumn("__tok", F.coalesce(tokened, F.lit(False)))
    for name, hits in layers.items():
        ids = hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("polygon_id")), "|").alias(f"{name}_ids"))
        out = out.join(ids, key, "left").withColumn(f"{name}_ids", F.when(F.col("__loc"), F.coalesce(f"{name}_ids", F.lit(""))))
    place = F.lit("off the map")
    for name in reversed(layers):
        place = F.when(F.col(f"{name}_ids") != "", name).otherwise(place)
    out = out.withColumn("place", F.when(F.col("__loc"), place)).join(strongest(lights, key, "state", order).withColumnRenamed("state", "__light"), key, "left")
    return out.withColumn("light", F.when(F.col("__loc") & F.col("__tok"), F.col("__light"))).drop("__loc", "__tok", "__light")


def adjacency(sources: DataFrame, edges: DataFrame, *, key: str, own: str, via: str) -> DataFrame:
    """Per key its own links if it has any, else those reached by an edge: (key, links), sorted, [] for neither.

    sources: (key, own, via); edges: (via, link). Sorted distinct arrays.
    """
    out = edges.groupBy(via).agg(F.array_sort(F.collect_set("link")).alias("reach"))
    mine = sources.groupBy(key).agg(F.array_sort(F.collect_set(own)).alias("mine"))
    reach = sources.join(out, via).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reach")))).alias("far"))
    empty = F.array().cast(mine.schema["mine"].dataType)
    return mine.join(reach, key, "left").select(key, F.when(F.size("mine") > 0, F.col("mine")).otherwise(F.coalesce("far", empty)).alias("links"))


def strongest(states: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Per key the known state that comes first in `order`; 'unknown' if all its states are others or null."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(state) == name, i).otherwise(rank)
    back = F.lit("unknown")
    for i, name in enumerate(order):
        back = F.when(F.col("__best") == i, name).otherwise(back)
    return states.groupBy(key).agg(F.min(rank).alias("__best")).select(key, back.alias("state"))
