"""The operational picture: the clustered detections, kept for as long as the reference time allows, and what is built on them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.operators import cluster
from cinderlake.sources import adapters
from cinderlake.storage import Stored

#: Seconds for which a built picture may be served again, and the least time between forced rebuilds.
MAX_AGE_S, COOLDOWN_S = 600, 60

_built: dict[tuple[str, str], tuple[float, DataFrame]] = {}


def clustered(spark: SparkSession, sf_dir: str, max_age: float = MAX_AGE_S, force: bool = False) -> DataFrame:
    """Detections of the window with their cluster, written to the shared folder and served from there until too old."""
    key = spark.sparkContext.applicationId, sf_dir
    found = _built.get(key)
    age = time.monotonic() - found[0] if found else None
    if found and (age < COOLDOWN_S if force else age < max_age):
        return found[1]
    fresh = Stored(cluster.members(adapters.detections(spark, sf_dir)), "picture").df
    _built[key] = time.monotonic(), fresh
    return fresh


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.incidents(clustered(spark, sf_dir), adapters.now_hours(spark, sf_dir))


def land_cover_of(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``cluster, cover_code, fuel, label, burnable``: the cover that the adapter lays under each incident."""
    codes = sorted([c for c, _ in dims.LAND_COVER_FUEL] + [c for c, _ in dims.NON_BURNABLE])
    at = F.element_at(F.array(*map(F.lit, codes)), (F.col("cluster") % len(codes) + 1).cast("int"))
    coded = found.select("cluster", at.alias("cover_code"))
    dim = F.broadcast(dims.land_cover(spark).withColumnRenamed("code", "cover_code"))
    return coded.join(dim, "cover_code", "left").withColumn("burnable", F.col("fuel").isNotNull())


def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.signals(clustered(spark, sf_dir))
    return cluster.assess(found.join(land_cover_of(spark, found), "cluster"))
