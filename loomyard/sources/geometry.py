"""Geometry blobs of GeoPackage layers to rings, by an Arrow batch function."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of the envelope by its code, as the public format defines it.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def strip_header(blob: bytes) -> bytes:
    """The well-known binary inside a GeoPackage blob; raises for others."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + ENVELOPE_BYTES[(blob[3] >> 1) & 7] :]


def rings(wkb: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon (dimensions beyond x and y are skipped)."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if wkb[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", wkb, at + 1)
        extra = {0: 0, 1: 1, 2: 1, 3: 2}[code % 10000 // 1000] if code < 0x10000000 else bool(code & 0x80000000) + bool(code & 0x40000000)
        kind, at = (code % 1000 if code < 0x10000000 else code & 0xFF), at + 5
        (n,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        if kind == 6:
            for _ in range(n):
                at = read(at)
            return at
        if kind != 3:
            raise ValueError(f"geometry of kind {kind}")
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", wkb, at)
            at += 4
            size = 8 * (2 + extra)
            out.append([struct.unpack_from(order + "dd", wkb, at + i * size) for i in range(m)])
            at += m * size
        return at

    read(0)
    return out


def read_layer(spark: SparkSession, path: str, layer: str, columns: list[str], geom: str = "geom") -> DataFrame:
    """The columns (as text) and the geometry blobs of a layer; one database is one partition, several paths are several."""
    from .sqlite import SqliteSource

    spark.dataSource.register(SqliteSource)
    names = ", ".join(f'CAST("{c}" AS TEXT) AS "{c}"' for c in columns)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("sqlitelog").schema(f"{schema}{', ' if columns else ''}`{geom}` binary").option("query", f'SELECT {names}{", " if columns else ""}"{geom}" FROM "{layer}"').option("paths", path).load()


def projected_crs(spark: SparkSession, path: str, table: str = "meta", key: str = "projectedCoordSystem") -> str:
    """The coordinate system that the databases name under a key of their metadata; they must agree."""
    from .sqlite import SqliteSource

    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlitelog").schema("value string").option("query", f"""SELECT value FROM "{table}" WHERE key = '{key}'""").option("paths", path).load().distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: {len(rows)} coordinate systems instead of one")
    return rows[0][0]


def load_map(spark: SparkSession, path: str, layers: dict[str, str], adjacency: tuple[str, str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(edges per layer, links) of a map: layers name the key column of each layer; adjacency is (layer, from, to)."""
    edges = {name: polygon_edges_of(read_layer(spark, path, name, [key]), key, "geom") for name, key in layers.items()}
    layer, a, b = adjacency
    links = read_layer(spark, path, layer, [a, b]).select(F.col(a).cast("long").alias("via"), F.col(b).cast("long").alias("link")).where("via is not null and link is not null").distinct()
    return edges, links


def polygon_edges_of(layer: DataFrame, key: str, geom: str) -> DataFrame:
    """(polygon_id, x1, y1, x2, y2) of all rings; null and broken geometries give no edge."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, g in zip(p.iloc[:, 0], p.iloc[:, 1]):
                try:
                    every = rings(strip_header(bytes(g))) if g is not None else []
                except (ValueError, struct.error, KeyError, IndexError):
                    continue
                rows += [(k, *a, *b) for r in every for a, b in zip(r, [*r[1:], r[0]]) if a != b]
            yield pd.DataFrame(rows, columns=["polygon_id", "x1", "y1", "x2", "y2"])

    return layer.select(F.col(key).cast("long"), geom).mapInPandas(run, "polygon_id long, x1 double, y1 double, x2 double, y2 double")


def utm(lon, lat, zone: int):
    """(easting, northing) columns of a longitude and latitude in degrees, northern hemisphere, by the Krueger series."""
    # The WGS 84 ellipsoid, and the scale and false easting of the projection.
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * x, 0.9996 * big * y
