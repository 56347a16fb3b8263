"""Queries on imagery, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions import formulas as f
from cinderlake.operators import raster, regions
from cinderlake.plans.oracles import AROUND, OUTLINE
from cinderlake.plans.picture import incidents
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters

query = Registry()

PIX = """(SELECT site, "row", col, scene, CASE WHEN burnt THEN 1500 + n * 3 % 400 ELSE 3000 + n * 5 % 900 END AS b8a, CASE WHEN burnt THEN 2600 + n * 11 % 900 ELSE 1600 + n * 7 % 500 END AS b12, 1800 + n * 13 % 700 AS b11, 700 + n * 17 % 500 AS b04, CASE WHEN n % 17 = 0 THEN 9 WHEN n % 29 = 0 THEN 6 ELSE 4 END AS scl
  FROM (SELECT *, scene = 'post' AND n % 3 <> 0 AS burnt FROM (SELECT user_id AS site, (8 + event_id % 8)::INTEGER AS "row", (8 + event_id // 9 % 8)::INTEGER AS col, min(event_id) AS n FROM events GROUP BY ALL), (VALUES ('pre'), ('post')) s(scene)))"""
R = raster.reflectance
VALID = f"(scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND {R('b8a')} > 0)"
IND = f"(SELECT *, CASE WHEN valid THEN {f.normalised_difference(R('b8a'), R('b12'))} END AS nbr, CASE WHEN valid THEN {f.normalised_difference(R('b8a'), R('b11'))} END AS ndmi, CASE WHEN valid THEN {f.normalised_difference(R('b8a'), R('b04'))} END AS ndvi FROM (SELECT *, {VALID} AS valid, scl = 6 AS water FROM {PIX}))"
DIFF = f"(SELECT *, CASE WHEN dnbr IS NOT NULL THEN {f.burn_class('dnbr')} END AS severity FROM (SELECT p.site, p.\"row\", p.col, p.nbr AS pre, p.valid AND q.valid AS valid, p.water OR q.water AS water, CASE WHEN p.valid AND q.valid THEN p.nbr - q.nbr END AS dnbr FROM {IND} p JOIN {IND} q USING (site, \"row\", col) WHERE p.scene = 'pre' AND q.scene = 'post'))"
PATCH = f"""WITH RECURSIVE burnt AS (SELECT *, (site * 16 + "row") * 16 + col AS pixel FROM {DIFF} WHERE dnbr >= 0.1e0 AND NOT water),
pedge AS (SELECT p.pixel AS a, q.pixel AS b FROM burnt p JOIN burnt q ON p.site = q.site AND abs(p."row" - q."row") + abs(p.col - q.col) = 1),
preach(pixel, other) AS (SELECT pixel, pixel FROM burnt UNION SELECT r.pixel, e.b FROM preach r JOIN pedge e ON e.a = r.other),
patched AS (SELECT burnt.*, patch FROM burnt JOIN (SELECT pixel, min(other) AS patch FROM preach GROUP BY pixel) USING (pixel)),
seeded AS (SELECT * FROM patched SEMI JOIN (SELECT patch FROM patched GROUP BY patch HAVING count(*) * 0.04e0 >= 0.5e0 AND min(sqrt(power(("row" - 12) * 20e0, 2) + power((col - 12) * 20e0, 2))) <= 1500e0) k USING (patch))
"""


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.indices(adapters.pixels(spark, sf_dir))


@query("nd_indices", f'SELECT site, "row", col, scene, {f.rnd("nbr", 4)} AS nbr, {f.rnd("ndmi", 4)} AS ndmi, {f.rnd("ndvi", 4)} AS ndvi, valid, water FROM {IND}')
def nd_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack(spark, sf_dir).select("site", "row", "col", "scene", *(F.expr(f.rnd(c, 4)).alias(c) for c in ("nbr", "ndmi", "ndvi")), "valid", "water")


@query("red_to_20m", f'SELECT site, scene, "row" // 2 AS "row", col // 2 AS col, {f.rnd("avg(b04)", 3)} AS b04 FROM {PIX} GROUP BY site, scene, "row" // 2, col // 2')
def red_to_20m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.to_coarse(adapters.pixels(spark, sf_dir))


@query("dnbr_classes", f'SELECT site, "row", col, {f.rnd("dnbr", 4)} AS dnbr, severity FROM {DIFF}')
def dnbr_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.burn_difference(stack(spark, sf_dir)).select("site", "row", "col", F.expr(f.rnd("dnbr", 4)).alias("dnbr"), "severity")


def seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    difference = raster.burn_difference(stack(spark, sf_dir))
    return difference, raster.near_seed(raster.patches(difference), 1500.0)


@query("burn_patches", PATCH + "SELECT patch, site, count(*) AS pixels FROM patched GROUP BY patch, site")
def burn_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.patches(raster.burn_difference(stack(spark, sf_dir))).groupBy("patch", "site").agg(F.count("*").alias("pixels"))


@query("burn_polygons", PATCH + f"SELECT * FROM (SELECT site, patch, count(*) AS cells FROM patched GROUP BY ALL) JOIN (SELECT site, patch, {OUTLINE} FROM ({AROUND.format(keys='site, patch', cells='patched')}) GROUP BY ALL) USING (site, patch)")
def burn_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of every burnt patch: area, corners and length in sides, by its rings."""
    found = raster.patch_polygons(raster.patches(raster.burn_difference(stack(spark, sf_dir))))
    return found.select("site", "patch", "cells", "corners", regions.perimeter("rings").alias("sides"))


@query("severity_ha", PATCH + f"SELECT site, severity, {f.rnd('count(*) * 0.04e0', 2)} AS ha FROM seeded GROUP BY site, severity")
def severity_ha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.severity_areas(seeded(spark, sf_dir)[1])


@query(
    "burn_scar",
    PATCH
    + f""", sev AS (SELECT site, severity, {f.rnd('count(*) * 0.04e0', 2)} AS ha FROM seeded GROUP BY site, severity),
tot AS (SELECT site, {f.rnd('avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END)', 3)} AS usable FROM {DIFF} GROUP BY site),
bur AS (SELECT site, {f.rnd('count(*) * 0.04e0', 2)} AS burned_ha, {f.rnd('avg(dnbr)', 4)} AS mean_dnbr, {f.rnd(f"avg({f.relative_dnbr('dnbr', 'pre')})", 4)} AS mean_rdnbr FROM seeded GROUP BY site)
SELECT site, usable, burned_ha, mean_dnbr, mean_rdnbr, dominant, CASE WHEN usable < 0.4e0 THEN 'too cloudy' WHEN burned_ha IS NULL THEN 'no scar' ELSE 'measured' END AS outcome
FROM tot LEFT JOIN bur USING (site) LEFT JOIN (SELECT site, arg_max(severity, (ha, severity)) AS dominant FROM sev GROUP BY site) USING (site)""",
)
def burn_scar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.scar(*seeded(spark, sf_dir))


@query("ring_median", f'SELECT site, count(*) AS n, {f.rnd("median(ndmi)", 4)} AS ndmi, {f.rnd("median(ndvi)", 4)} AS ndvi FROM {IND} WHERE scene = \'pre\' AND valid AND NOT water AND sqrt(power(("row" - 12) * 20e0, 2) + power((col - 12) * 20e0, 2)) > 60 AND sqrt(power(("row" - 12) * 20e0, 2) + power((col - 12) * 20e0, 2)) <= 200 GROUP BY site HAVING count(*) >= 5')
def ring_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.ring_medians(stack(spark, sf_dir), 60.0, 200.0, 5)


SCENES = "(SELECT event_id AS scene_id, user_id AS site, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS observed_h, event_id * 13 % 70 * 1e0 AS cloud_pct, event_id % 3 <> 0 AS covers FROM events WHERE event_type = 'view')"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = adapters.all_detections(spark, sf_dir).where("event_type = 'view'")
    return seen.select(F.col("id").alias("scene_id"), F.col("user_id").alias("site"), F.col("hours").alias("observed_h"), (F.col("id") * 13 % 70 * 1.0).alias("cloud_pct"), (F.col("id") % 3 != 0).alias("covers"))


@query("best_scene", f"SELECT site, scene_id, cloud_pct, covers FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT covers, floor(cloud_pct / 10), observed_h DESC, scene_id) AS k FROM {SCENES} WHERE cloud_pct <= 40) WHERE k = 1")
def best_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.best_scene(scenes(spark, sf_dir))


@query("scene_search", f"SELECT scene_id, site, cloud_pct FROM {SCENES} WHERE observed_h BETWEEN 240 AND 480 ORDER BY observed_h DESC, scene_id LIMIT 40")
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty newest scenes of a time window; the limit is the search's own."""
    return scenes(spark, sf_dir).where("observed_h BETWEEN 240 AND 480").orderBy(F.col("observed_h").desc(), "scene_id").limit(40).select("scene_id", "site", "cloud_pct")


@query("scar_confidence", f"SELECT u / 10e0 AS usable, g AS gap_days, b AS burning, {f.scar_confidence('(u / 10e0)', 'g', 'b')} AS confidence FROM (SELECT unnest(range(0, 11)) AS u), (VALUES (3), (20), (45)) g(g), (VALUES (true), (false)) b(b)")
def scar_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(11).select((F.col("id") / 10.0).alias("usable")).withColumn("gap_days", F.explode(F.array(*map(F.lit, (3, 20, 45))))).withColumn("burning", F.explode(F.array(F.lit(True), F.lit(False))))
    return grid.withColumn("confidence", F.expr(f.scar_confidence("usable", "gap_days", "burning")))


MEASURED = "CASE WHEN cluster % 3 = 0 THEN area_ha * 1.5e0 + 1e0 END"


@query(
    "area_override",
    f"""SELECT cluster, area_source, area_ha, growth, {f.severity('score')} AS severity FROM (SELECT *, {f.rnd(f.severity_score('area_ha', 'total_frp', 'growth'), 2)} AS score FROM (
  SELECT cluster, total_frp, CASE WHEN m IS NULL THEN 'detections' ELSE 'image' END AS area_source, {f.rnd('coalesce(m, area_ha)', 1)} AS area_ha, CASE WHEN m IS NOT NULL AND (SELECT now FROM nowh) - first_h >= 1 THEN {f.rnd('m / ((SELECT now FROM nowh) - first_h)', 2)} ELSE growth END AS growth
  FROM (SELECT *, {MEASURED} AS m FROM inc)))""",
)
def area_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured area replaces the one counted from detections, and growth and severity follow it."""
    found = incidents(spark, sf_dir)
    measured = found.select("cluster", F.expr(MEASURED).alias("m")).where("m IS NOT NULL")
    return override_area(found, measured, adapters.now_hours(spark, sf_dir)).select("cluster", "area_source", "area_ha", "growth", "severity")


def override_area(found: DataFrame, measured: DataFrame, image_h: float) -> DataFrame:
    both = found.drop("score", "severity").join(measured, "cluster", "left").withColumn("_age", F.lit(image_h) - F.col("first_h"))
    new = both.withColumns({
        "area_source": F.when(F.col("m").isNull(), "detections").otherwise("image"),
        "growth": F.expr(f"CASE WHEN m IS NOT NULL AND _age >= 1 THEN {f.rnd('m / _age', 2)} ELSE growth END"),
    }).withColumn("area_ha", F.expr(f.rnd("coalesce(m, area_ha)", 1)))
    scored = new.withColumn("score", F.expr(f.rnd(f.severity_score("area_ha", "total_frp", "growth"), 2)))
    return scored.withColumn("severity", F.expr(f.severity("score"))).drop("m", "_age")
