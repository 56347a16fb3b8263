"""Deterministic inputs of the fire model, computed from the star-schema tables.

There is no geospatial table among the given ones, so detections, hourly weather, ground heights and image pixels are
integer arithmetic over ``events``. The same arithmetic stands in DuckDB SQL in ``plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01

# Where a user's detections lie, in thousandths of a degree: one in ten among the places of the densest region, so that
# there is something for a fire to reach; the others all over the area.
LATITUDE = "CASE WHEN user_id % 10 = 0 THEN 37700 + user_id * 37 % 80 * 10 ELSE 35000 + user_id * 37 % 650 * 10 END"
LONGITUDE = "CASE WHEN user_id % 10 = 0 THEN 23300 + user_id * 53 % 80 * 10 ELSE 20000 + user_id * 53 % 900 * 10 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a detection; ``hours`` since 2024-01-01 UTC."""
    return detections_of(table(spark, sf_dir, "events"))


def detections_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))
    number = F.col("event_id")
    return e.select(
        number.alias("id"), F.col("user_id"), F.col("event_type"), F.col("us"),
        ((F.col("us") - EPOCH_US) / 3.6e9).alias("hours"),
        ((F.expr(LATITUDE) + number * 17 % 41 - 20) / 1000.0).alias("latitude"),
        ((F.expr(LONGITUDE) + number * 29 % 37 - 18) / 1000.0).alias("longitude"),
        F.col("value").alias("frp_mw"),
        F.expr("CASE event_type WHEN 'view' THEN 'viirs_snpp' WHEN 'click' THEN 'viirs_noaa20' WHEN 'signup' THEN 'viirs_noaa21' WHEN 'purchase' THEN 'modis_terra' ELSE 'modis_aqua' END").alias("satellite"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 0.375e0 WHEN 1 THEN 0e0 WHEN 3 THEN 0.5e0 WHEN 4 THEN 1e0 END").alias("scan_km"),
        ((F.floor(F.col("us") / 3_600_000_000) % 24).between(6, 17)).alias("is_daytime"),
        F.floor((F.col("us") - EPOCH_US) / 86_400_000_000).alias("day"),
    )


def detections(spark: SparkSession, sf_dir: str, days: int = dims.DAY_WINDOW) -> DataFrame:
    """The detections of the last ``days`` days before the newest one.

    The newest time is an aggregate of one column; the filter compares ``ts`` itself, so that the scan can skip by it.
    """
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max(micros("ts"))).first()[0]
    after = F.timestamp_micros(F.lit((newest or 0) - days * 86_400_000_000)).cast(events.schema["ts"].dataType)
    return detections_of(events.where(F.col("ts") > after))


def recent(every: DataFrame, days: int = dims.DAY_WINDOW) -> DataFrame:
    newest = every.agg(F.max("us")).first()[0]
    return every.where(F.col("us") > (newest or 0) - days * 86_400_000_000)


def newest_hours(events: DataFrame) -> float:
    newest = events.agg(F.max(micros("ts"))).first()[0]
    return ((newest or EPOCH_US) - EPOCH_US) / 3.6e9


def now_hours(spark: SparkSession, sf_dir: str) -> float:
    """The time of the newest event stands for the wall clock."""
    return newest_hours(table(spark, sf_dir, "events"))


def hourly_weather(spark: SparkSession, sf_dir: str, sites: DataFrame | None = None) -> DataFrame:
    """One reading for each site (``user_id``) and hour that has events: the one of the smallest event id. With ``sites(site)``, of these only."""
    events = table(spark, sf_dir, "events")
    if sites is not None:  # before anything is grouped
        events = events.join(sites.select(F.col("site").alias("user_id")), "user_id", "left_semi")
    e = events.select("event_id", "user_id", micros("ts").alias("us")).withColumn("hour", F.floor((F.col("us") - EPOCH_US) / 3_600_000_000))
    one = e.groupBy("user_id", "hour").agg(F.min("event_id").alias("n"))
    n = F.col("n")
    return one.select(
        F.col("user_id").alias("site"), "hour", F.floor(F.col("hour") / 24).alias("day"), (F.col("hour") % 24).alias("hour_of_day"),
        ((180 + n * 13 % 200) / 10.0).alias("temperature_c"),
        F.when(n % 23 != 0, (15 + n * 7 % 70) * 1.0).alias("humidity_pct"),
        F.when(n % 19 != 0, (n * 11 % 45) * 1.0).alias("wind_kmh"), ((n * 31 % 360) * 1.0).alias("wind_from_deg"),
        (F.when(n % 9 == 0, n % 12).otherwise(0) * 1.0).alias("rain_mm"),
        (F.floor(F.col("hour") / 24 / 30) % 12 + 6).cast("int").alias("month"), (F.expr(LATITUDE) / 1000.0).alias("latitude"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two co-registered scenes (pre, post) of pixels for each site: digital numbers, scene class, row and column.

    Rows and columns are 20 m apart; events place a pixel within 80 m north, south, east and west of the seed (12, 12).
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    number = F.col("event_id")
    cells = e.groupBy("user_id", (8 + number % 8).cast("int").alias("row"), (8 + F.floor(number / 9) % 8).cast("int").alias("col")).agg(F.min("event_id").alias("n"))
    n = F.col("n")
    scenes = F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("scene")
    long = cells.select(F.col("user_id").alias("site"), "row", "col", "n", scenes)
    burnt = (F.col("scene") == "post") & (n % 3 != 0)
    return long.select(
        "site", "row", "col", "scene",
        F.when(burnt, 1500 + n * 3 % 400).otherwise(3000 + n * 5 % 900).alias("b8a"),
        F.when(burnt, 2600 + n * 11 % 900).otherwise(1600 + n * 7 % 500).alias("b12"),
        (1800 + n * 13 % 700).alias("b11"), (700 + n * 17 % 500).alias("b04"),
        F.when(n % 17 == 0, 9).when(n % 29 == 0, 6).otherwise(4).alias("scl"),
    )
