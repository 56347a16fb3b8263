"""Orders of threats and places, what limits a spread estimate, and ground and moisture flags, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import geo, terrain
from cinderlake.plans import fire_queries as fire
from cinderlake.plans.picture import incidents
from cinderlake.plans.registry import Registry

query = Registry()


@query("threat_order", f"SELECT cluster, name, hit_count, earliest, row_number() OVER (PARTITION BY cluster ORDER BY hit_count DESC, earliest NULLS LAST, place_no) AS k FROM ({fire.THREATS})")
def threat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threatened places of an incident: most scenarios first, then the earliest arrival; at most 51 places to a fire."""
    order = Window.partitionBy("cluster").orderBy(F.col("hit_count").desc(), F.col("earliest").asc_nulls_last(), "place_no")
    return fire.threats(spark, sf_dir).select("cluster", "name", "hit_count", "earliest", F.row_number().over(order).cast("long").alias("k"))


@query("places_nearest_first", "SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY km, place_no) AS k FROM near WHERE km <= 80")
def places_nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = geo.places_within(incidents(spark, sf_dir), dims.places(spark), 80.0)
    return near.select("cluster", "name", F.row_number().over(Window.partitionBy("cluster").orderBy("km", "place_no")).cast("long").alias("k"))


def whole(x: str) -> str:
    return f"CAST(CAST(floor({x} + 0.5e0) AS BIGINT) AS STRING)"


def caveats(push: str, effective: str) -> str:
    """What limits an estimate, in its order; ``push`` is the slope as km/h of wind, null where no slope is known."""
    return f"""concat_ws(' ', concat('One fuel throughout: ', fuel_used, '.'),
      CASE WHEN {push} IS NULL THEN 'Heights unknown, so flat: too slow uphill.' ELSE concat('The slope counts for ', {whole(push)}, ' km/h of wind.') END,
      CASE WHEN {push} > 2 * wind AND {effective} > wind THEN 'It outweighs the wind and sets the heading.' END,
      'Flying embers and burning crowns are left out.', CASE WHEN {effective} > 40 THEN 'Beyond 40 km/h of joint push the estimate is poor.' END,
      CASE WHEN abs(moist - 1) >= 0.02e0 THEN concat('Plant moisture makes it ', {whole('abs(1 - moist) * 100')}, CASE WHEN moist > 1 THEN ' % quicker.' ELSE ' % slower.' END) ELSE 'Plant moisture is ordinary.' END)"""


PUSH = f"CASE WHEN aspect IS NOT NULL AND slope > 0 THEN {f.slope_wind_kmh('slope')} END"


@query("spread_caveats", f"SELECT cluster, scenario, {caveats(PUSH, 'ew')} AS caveats FROM ({fire.SCEN})")
def spread_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caveats of every incident under every scenario."""
    return fire.ensemble(spark, sf_dir).select("cluster", "scenario", F.expr(caveats(PUSH, "effective_wind")).alias("caveats"))


LEAST_CHANGE = 0.05  # fixed value: a factor this far from one is told


@query("moisture_flags", f"SELECT cluster, fuel, lfm > extinction AS above_extinction, abs(factor - 1) >= {f.num(LEAST_CHANGE)} AS is_significant FROM (SELECT *, {f.spread_factor('lfm', 'lfmc_dry', 'lfmc_wet', 'reference')} AS factor FROM (SELECT cluster, moist.*, {f.rnd(f.live_moisture(fire.NDMI, 'ndmi_dry', 'ndmi_wet', 'lfmc_dry', 'lfmc_wet'), 2)} AS lfm FROM inc0, moist))")
def moisture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.live_moisture(spark, sf_dir).select("cluster", "fuel", "above_extinction", (F.abs(F.col("factor") - 1) >= LEAST_CHANGE).alias("is_significant"))


@query("cover_disjoint", "SELECT count(*) FILTER (fuel IS NOT NULL) AS burnable, count(*) FILTER (fuel IS NULL) AS unburnable, (SELECT count(*) FROM (SELECT code FROM lcover WHERE fuel IS NOT NULL INTERSECT SELECT code FROM lcover WHERE fuel IS NULL)) AS in_both FROM lcover")
def cover_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No code of land cover both burns and does not."""
    codes = dims.land_cover(spark)
    sides = codes.groupBy("code").agg(F.count_if(F.col("fuel").isNotNull()).alias("yes"), F.count_if(F.col("fuel").isNull()).alias("no"))
    return sides.agg(F.sum("yes").alias("burnable"), F.sum("no").alias("unburnable"), F.count_if((F.col("yes") > 0) & (F.col("no") > 0)).alias("in_both"))


HEIGHTS_FROM = 36.0  # the adapter's heights start at this latitude


@query("ground_or_flat", f"SELECT cluster, coalesce(slope_pct, 0e0) AS slope_pct, CASE WHEN plane.cluster IS NOT NULL THEN aspect_deg END AS aspect_deg, CASE WHEN plane.cluster IS NULL THEN 0 ELSE 25 END::BIGINT AS samples, plane.cluster IS NULL AS assumed_flat FROM inc LEFT JOIN (SELECT plane.* FROM plane JOIN inc USING (cluster) WHERE latitude >= {f.num(HEIGHTS_FROM)}) plane USING (cluster)")
def ground_or_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane under each incident, or flat ground with no samples where there are no heights."""
    found = incidents(spark, sf_dir)
    samples = terrain.heights(found.where(F.col("latitude") >= HEIGHTS_FROM))
    known = terrain.plane_fit(samples).join(samples.groupBy("cluster").agg(F.count("z").alias("samples")), "cluster")
    return found.select("cluster").join(known, "cluster", "left").select(
        "cluster", F.coalesce("slope_pct", F.lit(0.0)).alias("slope_pct"), "aspect_deg", F.coalesce("samples", F.lit(0).cast("long")).alias("samples"), F.col("samples").isNull().alias("assumed_flat"),
    )
