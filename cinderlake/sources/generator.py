"""Synthetic fires for trials: drifting fronts seen by a few overpasses a day, and scattered single pixels.

Everything is a hash of row number and seed, so a run gives the same rows on any cluster and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims

PASS_HOURS = (0, 1, 10, 11, 12, 21, 22)
#: Trial fires: latitude, longitude, hours, drift bearing, drift km per hour, peak MW, pixels of a pass.
FIRES = ((38.25, 23.90, 60, 200.0, 0.5, 180.0, 24), (37.70, 21.60, 36, 110.0, 0.3, 90.0, 14), (41.05, 26.20, 96, 160.0, 0.4, 220.0, 30), (36.20, 28.00, 48, 225.0, 0.35, 120.0, 16), (38.95, 23.20, 24, 90.0, 0.2, 60.0, 8))


def share(*keys) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)


def snapped(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The centre of the sensor cell of about 375 m around a position."""
    dlat = dims.PIXEL_KM / dims.KM_PER_DEGREE
    rows = F.round(lat / dlat) * dlat
    dlon = dlat / F.cos(F.radians(rows))
    return rows, F.round(lon / dlon) * dlon


def fires(spark: SparkSession, seed: int = 20240811, noise: int = 22) -> DataFrame:
    """``(fire, hours, latitude, longitude, frp_mw, satellite)``; fire -1 is noise."""
    named = dims.frame(spark, [(i, *x) for i, x in enumerate(FIRES)], "fire int, lat0 double, lon0 double, duration int, bearing double, speed double, peak double, per_pass int")
    passes = named.withColumn("d", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 24).cast("int")))).withColumn("h", F.explode(F.array(*map(F.lit, PASS_HOURS))))
    timed = passes.withColumn("hours", F.col("d") * 24 + F.col("h") + share("fire", "d", "h", F.lit(seed))).where("hours <= duration")
    spots = timed.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("per_pass"))))
    key = ("fire", "d", "h", "k")
    along = F.col("speed") * F.col("hours") * (0.4 + 0.6 * share(*key, F.lit(seed + 1)))
    across = (share(*key, F.lit(seed + 2)) - 0.5) * F.col("speed") * F.col("hours") / 2.5
    turn = F.radians("bearing")
    north, east = along * F.cos(turn) - across * F.sin(turn), along * F.sin(turn) + across * F.cos(turn)
    lat, lon = snapped(F.col("lat0") + north / dims.KM_PER_DEGREE, F.col("lon0") + east / (dims.KM_PER_DEGREE * F.cos(F.radians("lat0"))))
    satellites = F.array(*map(F.lit, ("viirs_snpp", "viirs_noaa20", "modis_terra")))
    front = spots.select("fire", "hours", lat.alias("latitude"), lon.alias("longitude"), (F.col("peak") * (0.1 + 0.9 * F.pow(share(*key, F.lit(seed + 3)), 2))).alias("frp_mw"), F.element_at(satellites, (1 + F.floor(3 * share("fire", "d", "h", F.lit(seed + 4)))).cast("int")).alias("satellite"))
    n = spark.range(noise)
    at = snapped(dims.AOI_SOUTH + (dims.AOI_NORTH - dims.AOI_SOUTH) * share("id", F.lit(seed + 5)), dims.AOI_WEST + (dims.AOI_EAST - dims.AOI_WEST) * share("id", F.lit(seed + 6)))
    scattered = n.select(F.lit(-1).alias("fire"), (96 * share("id", F.lit(seed + 7))).alias("hours"), at[0].alias("latitude"), at[1].alias("longitude"), (0.5 + 4 * share("id", F.lit(seed + 8))).alias("frp_mw"), F.lit("viirs_noaa21").alias("satellite"))
    return front.unionByName(scattered)
