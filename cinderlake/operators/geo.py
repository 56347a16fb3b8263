"""Places and areas: containment in an outline, places within reach, the nearest place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f


def within_boundary(points: DataFrame, edges: DataFrame, margin_km: float = 0.0) -> DataFrame:
    """Adds ``inside``: in the outline by even-odd crossings, or within ``margin_km`` of it (in degrees of latitude).

    The outline is a dimension of a few dozen edges; it is folded per row from one array, so points are not shuffled.
    An empty outline keeps all points inside.
    """
    ring = edges.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("ring"))
    rows = points.crossJoin(F.broadcast(ring))
    x, y = F.col("longitude"), F.col("latitude")
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    odd = F.aggregate("ring", F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1

    def apart(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.least(F.greatest(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    inside = odd
    if margin_km:
        nearest = F.aggregate("ring", F.lit(1e9), lambda m, e: F.least(m, apart(e)))
        inside = odd | (nearest <= margin_km / dims.KM_PER_DEGREE)
    return rows.withColumn("inside", F.when(F.size("ring") == 0, True).otherwise(inside)).drop("ring")


def with_places(incidents: DataFrame, places: DataFrame) -> DataFrame:
    """Each incident with each place: distance and bearing. ``places`` is a dimension of 51 rows."""
    named = F.broadcast(places.withColumnsRenamed({"latitude": "plat", "longitude": "plon"}))
    both = incidents.crossJoin(named)
    km = f.haversine_km("latitude", "longitude", "plat", "plon")
    return both.withColumn("km", F.expr(km)).withColumn("bearing", F.expr(f.bearing_deg("latitude", "longitude", "plat", "plon")))


def places_within(incidents: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """Pairs within ``radius_km``; a band of latitudes is checked before any trigonometry."""
    band = 1.01 * radius_km / (math.pi * dims.EARTH_RADIUS_KM / 180.0)
    named = F.broadcast(places.withColumnsRenamed({"latitude": "plat", "longitude": "plon"}))
    both = incidents.join(named, F.col("plat").between(F.col("latitude") - band, F.col("latitude") + band))
    km = F.expr(f.haversine_km("latitude", "longitude", "plat", "plon"))
    return both.withColumn("km", km).where(F.col("km") <= radius_km).withColumn("bearing", F.expr(f.bearing_deg("latitude", "longitude", "plat", "plon")))


def nearest_place(incidents: DataFrame, places: DataFrame, most_km: float = dims.NEAREST_PLACE_KM) -> DataFrame:
    """``cluster, place, place_km`` of the nearest settlement or reserve; nulls beyond ``most_km``. First place wins a tie."""
    named = places.where(F.col("kind").isin("settlement", "natura2000"))
    near = places_within(incidents.select("cluster", "latitude", "longitude"), named, most_km)
    best = near.groupBy("cluster").agg(F.min(F.struct("km", "place_no", "name")).alias("b")).select("cluster", F.col("b.name").alias("place"), F.col("b.km").alias("place_km"))
    return incidents.select("cluster").join(best, "cluster", "left")
