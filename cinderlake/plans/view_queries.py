"""Queries of the list, the dossier and the status page beyond the layers, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import raster
from cinderlake.operators.ranking import numbered
from cinderlake.plans import fire_queries as fire
from cinderlake.plans import raster_queries as images
from cinderlake.plans.picture import clustered, incidents
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters

query = Registry()

PAD = "CASE WHEN (north - south) * 111.32e0 > 40 OR (east - west) * 111.32e0 * cos(radians((north + south) / 2)) > 40 THEN NULL ELSE {} END"
SIDES = ("west", "south", "east", "north")


@query("padded_bbox", f"SELECT cluster, {', '.join(f'{f.rnd(PAD.format(s), 4)} AS {s}' for s in SIDES)} FROM (SELECT cluster, min(longitude) - 0.05e0 AS west, min(latitude) - 0.05e0 AS south, max(longitude) + 0.05e0 AS east, max(latitude) + 0.05e0 AS north FROM mem WHERE cluster >= 0 GROUP BY cluster)")
def padded_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around an incident that imagery is read for; none where a side is longer than 40 km."""
    box = clustered(spark, sf_dir).where("cluster >= 0").groupBy("cluster").agg(
        (F.min("longitude") - 0.05).alias("west"), (F.min("latitude") - 0.05).alias("south"), (F.max("longitude") + 0.05).alias("east"), (F.max("latitude") + 0.05).alias("north"),
    )
    return box.select("cluster", *(F.expr(f.rnd(PAD.format(s), 4)).alias(s) for s in SIDES))


SITED = "(SELECT inc0.*, user_id AS site FROM inc0 JOIN (SELECT id, user_id FROM det) d ON d.id = cluster)"


@query(
    "scene_windows",
    f"""SELECT cluster, count(*) FILTER (observed_h BETWEEN first_h - 12 - 1080 AND first_h - 12) AS before, count(*) FILTER (observed_h BETWEEN first_h + 12 AND least(last_h + 720, (SELECT now FROM nowh))) AS after
  FROM {SITED} s LEFT JOIN {images.SCENES} sc ON sc.site = s.site GROUP BY cluster""",
)
def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of a site in the search windows before and after an incident: an equi-join with interval conditions."""
    site = clustered(spark, sf_dir).where("id = cluster").select("cluster", F.col("user_id").alias("site"))
    found = incidents(spark, sf_dir).select("cluster", "first_h", "last_h").join(site, "cluster")
    both = found.join(images.scenes(spark, sf_dir).select("site", "observed_h"), "site", "left")
    b0, b1, a0, a1 = raster.windows_of(F.col("first_h"), F.col("last_h"), adapters.now_hours(spark, sf_dir))
    return both.groupBy("cluster").agg(F.count_if(F.col("observed_h").between(b0, b1)).alias("before"), F.count_if(F.col("observed_h").between(a0, a1)).alias("after"))


@query("severity_share", f"SELECT severity, count(*) AS incidents, {f.rnd('sum(area_ha)', 1)} AS ha, {f.rnd('100e0 * sum(area_ha) / (SELECT sum(area_ha) FROM inc)', 2)} AS share_pct FROM inc GROUP BY severity")
def severity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents(spark, sf_dir)
    by = found.groupBy("severity").agg(F.count("*").alias("incidents"), F.sum("area_ha").alias("a"))
    total = F.sum("a").over(Window.partitionBy(F.lit(0)))
    return by.withColumn("t", total).select("severity", "incidents", F.expr(f.rnd("a", 1)).alias("ha"), F.expr(f.rnd("100e0 * a / t", 2)).alias("share_pct"))


SORTS = {"area": "area_ha DESC", "growth": "growth DESC", "recency": "last_h DESC"}


@query("incident_sorts", " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort_key, row_number() OVER (ORDER BY {o}, cluster) AS place, cluster FROM inc)" for k, o in SORTS.items()))
def incident_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list under each of its sort keys."""
    found = incidents(spark, sf_dir)
    keys = {"area": F.col("area_ha").desc(), "growth": F.col("growth").desc(), "recency": F.col("last_h").desc()}
    parts = []
    for name, order in keys.items():
        parts.append(numbered(found.select("cluster", "area_ha", "growth", "last_h"), [order, F.col("cluster")]).select(F.lit(name).alias("sort_key"), "place", "cluster"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_downwind", f"SELECT cluster, name, minutes, {f.format_lead('minutes')} AS lead FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY minutes, place_no) AS k FROM ({fire.EXPOSED}) WHERE minutes IS NOT NULL AND downwind) WHERE k <= 3")
def top_downwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy("minutes", "place_no")
    due = fire.exposed(spark, sf_dir).where("minutes IS NOT NULL AND downwind").withColumn("k", F.row_number().over(order)).where("k <= 3")
    return due.select("cluster", "name", "minutes", F.expr(f.format_lead("minutes")).alias("lead"))


@query("system_health", "SELECT 'degraded' AS status, 1::BIGINT AS fixtures")
def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded as soon as one source other than imagery is served by its fixture."""
    from cinderlake.plans.source_queries import source_status

    served = source_status(spark, sf_dir).where("name <> 'imagery'")
    return served.agg(F.when(F.bool_or(F.col("mode") == "fixture"), "degraded").otherwise("ok").alias("status"), F.count_if(F.col("mode") == "fixture").alias("fixtures"))


RELATIVE = "CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(CAST(CAST(floor(m + 0.5e0) AS BIGINT) AS STRING), ' min ago') WHEN m < 1440 THEN concat(CAST(CAST(floor(m / 60e0 + 0.5e0) AS BIGINT) AS STRING), ' h ago') ELSE concat(CAST(CAST(floor(m / 1440e0 + 0.5e0) AS BIGINT) AS STRING), ' d ago') END"


@query("relative_times", f"SELECT cluster, {RELATIVE} AS seen, upper(left(status, 1)) || substr(status, 2) AS status_title FROM (SELECT cluster, status, ((SELECT now FROM nowh) - last_h) * 60e0 AS m FROM inc)")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ago = incidents(spark, sf_dir).withColumn("m", (F.lit(adapters.now_hours(spark, sf_dir)) - F.col("last_h")) * 60.0)
    return ago.select("cluster", F.expr(RELATIVE).alias("seen"), F.initcap(F.regexp_replace("status", "_", " ")).alias("status_title"))


@query("scar_perimeter", images.PATCH + f", sev AS (SELECT site, count(*) AS pixels, {f.rnd('count(*) * 0.04e0', 2)} AS area_ha FROM patched GROUP BY site) SELECT site, area_ha, 'image' AS method, CASE WHEN area_ha >= 1 THEN concat('Measured over ', pixels::VARCHAR, ' pixels.') ELSE 'Too small to outline.' END AS note FROM sev")
def scar_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burnt pixels of a site as a perimeter row with its note."""
    burnt = raster.patches(raster.burn_difference(images.stack(spark, sf_dir))).groupBy("site").agg(F.count("*").alias("pixels"), F.expr(f.rnd("count(*) * 0.04e0", 2)).alias("area_ha"))
    note = F.when(F.col("area_ha") >= 1, F.concat(F.lit("Measured over "), F.col("pixels").cast("string"), F.lit(" pixels."))).otherwise("Too small to outline.")
    return burnt.select("site", "area_ha", F.lit("image").alias("method"), note.alias("note"))


@query("gazetteer_by_region", "SELECT region, count(*) AS places, sum(population) AS population, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM place GROUP BY region")
def gazetteer_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.places(spark).groupBy("region").agg(F.count("*").alias("places"), F.sum("population").alias("population"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("quantised_lookup", "SELECT det.id, x.fwi FROM det LEFT JOIN (SELECT floor(latitude * 4) AS ky, floor(longitude * 4) AS kx, max(frp_mw) AS fwi FROM alldet GROUP BY ALL) x ON ky = floor(latitude * 4) AND kx = floor(longitude * 4)")
def quantised_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup by quarter-degree key, unknown where nothing is there: how elevation and cover are joined."""
    key = [F.floor(F.col("latitude") * 4).alias("ky"), F.floor(F.col("longitude") * 4).alias("kx")]
    grid = adapters.all_detections(spark, sf_dir).groupBy(*key).agg(F.max("frp_mw").alias("fwi"))
    return adapters.detections(spark, sf_dir).select("id", *key).join(grid, ["ky", "kx"], "left").select("id", "fwi")
