"""GeoJSON and JSON sinks: features as one JSON text per row, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))


def polygon(ring: str) -> Column:
    """``ring`` is an array of (lon, lat) structs, first and last alike."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))


def features(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One column ``feature`` with a GeoJSON feature per row; null properties are kept."""
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_features(rows: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, one file per partition."""
    rows.write.mode("overwrite").text(path)


def ellipse_ring(lat: str = "latitude", lon: str = "longitude", vertices: int = 96) -> Column:
    """The footprint of a spread (head_ros, back_ros, lb, direction, minutes) as a closed ring around its origin."""
    length = (F.col("head_ros") + F.col("back_ros")) * F.col("minutes") / 1000.0
    shift = length / 2 - F.col("back_ros") * F.col("minutes") / 1000.0
    half, wide = length / 2, length / F.greatest("lb", F.lit(1.0)) / 2
    turn = F.radians("direction")

    def vertex(k):
        a = k % vertices * (2 * 3.141592653589793 / vertices)
        u, v = shift + half * F.cos(a), wide * F.sin(a)
        east, north = u * F.sin(turn) + v * F.cos(turn), u * F.cos(turn) - v * F.sin(turn)
        return F.struct((F.col(lon) + east / (111.32 * F.cos(F.radians(lat)))).alias("lon"), (F.col(lat) + north / 111.32).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), vertex)


def convex_hull(points: DataFrame, key: str = "cluster") -> DataFrame:
    """``key, ring``: the hull of each group's points, by a monotone chain over an array of distinct sorted points.

    Expressed with higher-order functions: a fold drops points that turn the wrong way. Groups of fewer than three
    points have no hull. A group's array holds its distinct points to three decimals, bounded by the area it covers.
    """
    p = F.struct(F.round("longitude", 3).alias("lon"), F.round("latitude", 3).alias("lat"))
    sets = points.groupBy(key).agg(F.array_sort(F.collect_set(p)).alias("pts")).where(F.size("pts") >= 3)
    empty = F.slice(F.col("pts"), 1, 0)

    def turn(o, a, b):
        return (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (a["lat"] - o["lat"]) * (b["lon"] - o["lon"])

    def chain(pts):
        def add(hull, q):
            n = F.size(hull)
            keep = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: (k <= n) & (turn(F.get(hull, k - 2), F.get(hull, k - 1), q) > 0))
            good = F.coalesce(F.array_max(keep), F.least(n, F.lit(1)))
            return F.concat(F.slice(hull, F.lit(1), good), F.array(q))

        return F.aggregate(pts, empty, add)

    lower, upper = chain(F.col("pts")), chain(F.reverse("pts"))
    ring = F.concat(lower, F.slice(upper, F.lit(2), F.greatest(F.size(upper) - 1, F.lit(0))))
    return sets.select(key, ring.alias("ring"))
