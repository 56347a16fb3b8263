"""Map layers, list, dossier and display texts, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import regions
from cinderlake.operators.hulls import convex_hulls
from cinderlake.plans import fire_queries as fire
from cinderlake.plans.picture import clustered, incidents, plausibility
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters, sinks

query = Registry()


@query("layer_detections", "SELECT id, latitude, longitude, frp_mw, cluster < 0 AS is_noise FROM mem")
def layer_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered detections and noise in one layer."""
    every = clustered(spark, sf_dir)
    kept, noise = every.where("cluster >= 0"), every.where("cluster < 0")
    return kept.unionByName(noise).select("id", "latitude", "longitude", "frp_mw", (F.col("cluster") < 0).alias("is_noise"))


@query("layer_incidents", "SELECT incident_id, latitude, longitude, severity, status, area_ha, verdict FROM inc JOIN judged USING (cluster)")
def layer_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).join(plausibility(spark, sf_dir).select("cluster", "verdict"), "cluster").select("incident_id", "latitude", "longitude", "severity", "status", "area_ha", "verdict")


#: Half a pixel in degrees, how far an outline lies beyond the detections; and what a hull is trusted.
HALF_PIXEL, HULL_CONFIDENCE = dims.PIXEL_KM / 2 / dims.KM_PER_DEGREE, 0.45
# Sides of a hull: pairs of points that no other point of the cluster lies to the right of, nor beyond in line. Positions are whole thousandths of a degree.
HULL = """
  SELECT cluster, px, py, qx, qy FROM (SELECT DISTINCT cluster, round(longitude * 1000)::BIGINT AS px, round(latitude * 1000)::BIGINT AS py FROM mem WHERE cluster >= 0) p
  JOIN (SELECT DISTINCT cluster, round(longitude * 1000)::BIGINT AS qx, round(latitude * 1000)::BIGINT AS qy FROM mem WHERE cluster >= 0) q USING (cluster)
  JOIN (SELECT DISTINCT cluster, round(longitude * 1000)::BIGINT AS rx, round(latitude * 1000)::BIGINT AS ry FROM mem WHERE cluster >= 0) r USING (cluster)
  WHERE px <> qx OR py <> qy GROUP BY ALL
  HAVING bool_and((qx - px) * (ry - py) - (qy - py) * (rx - px) > 0 OR ((qx - px) * (ry - py) - (qy - py) * (rx - px) = 0 AND rx BETWEEN least(px, qx) AND greatest(px, qx) AND ry BETWEEN least(py, qy) AND greatest(py, qy)))"""


def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of incidents of three detections or more, half a pixel further out."""
    found = convex_hulls(clustered(spark, sf_dir).where("cluster >= 0"), "cluster", radius=HALF_PIXEL).where("n >= 3")
    return found.join(incidents(spark, sf_dir).select("cluster", "incident_id", "severity", "area_ha", "last_h"), "cluster").withColumn("method", F.lit("detection_hull")).withColumn("confidence", F.lit(HULL_CONFIDENCE))


@query(
    "perimeter_hulls",
    f"""SELECT cluster, n, {f.rnd('coalesce(hull_area, 0e0)', 9)} AS hull_area, {f.rnd('coalesce(hull_length, 0e0)', 6)} AS hull_length, area_ha, 'detection_hull' AS method, 0.45e0 AS confidence FROM (SELECT cluster, count(*) AS n FROM mem WHERE cluster >= 0 GROUP BY cluster HAVING count(*) >= 3) c
  LEFT JOIN (SELECT cluster, sum(px * qy - qx * py) / 2e6 AS hull_area, sum(sqrt(power((qx - px) / 1e3, 2) + power((qy - py) / 1e3, 2))) AS hull_length FROM ({HULL}) GROUP BY cluster) h USING (cluster) JOIN inc USING (cluster)""",
)
def perimeter_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and length (degrees) of the hull of each incident of three detections or more, with how it was made and what it is trusted."""
    return hulls(spark, sf_dir).select("cluster", "n", F.expr(f.rnd("hull_area", 9)).alias("hull_area"), F.expr(f.rnd("hull_length", 6)).alias("hull_length"), "area_ha", "method", "confidence")


@query("layer_perimeters")
def layer_perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of incidents of three detections or more, as GeoJSON; a sketch around detections, and named so."""
    both = hulls(spark, sf_dir).withColumn("is_measured", F.lit(False))
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    return sinks.features(both.withColumn("ring", ring), sinks.polygon("ring"), ["incident_id", "severity", "area_ha", "method", "confidence", "is_measured"])


@query("layer_exposure", f"SELECT cluster, name, minutes, downwind FROM ({fire.EXPOSED}) WHERE minutes IS NOT NULL OR downwind")
def layer_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.exposed(spark, sf_dir).where("minutes IS NOT NULL OR downwind").select("cluster", "name", "minutes", "downwind")


@query("layer_places", "SELECT name, latitude, longitude, kind, population, region FROM place")
def layer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.places(spark).drop("place_no")


def projections(spark: SparkSession, sf_dir: str, kind: str = "envelope", incident_id: str | None = None) -> DataFrame:
    """Projected footprints as GeoJSON, the longest horizon first: the union of all scenarios (``envelope``), what they agree on (``core``), or each (``scenarios``).

    ``incident_id`` restricts them to one incident; one that is not there gives no rows.
    """
    if kind not in ("envelope", "core", "scenarios"):
        raise ValueError(f"no such kind of projection: {kind}")
    named = incidents(spark, sf_dir).select("cluster", "incident_id", "severity", "latitude", "longitude")
    if incident_id is not None:
        named = named.where(F.col("incident_id") == incident_id)
    every = fire.ensemble(spark, sf_dir).join(named.select("cluster"), "cluster", "left_semi")
    prints = fire.spread.footprints(every)
    if kind == "scenarios":
        each = prints.where("area_ha > 0").join(named.select("cluster", "incident_id"), "cluster").orderBy(F.col("minutes").desc(), "cluster", "scenario_no")
        return sinks.features(each.withColumn("ring", sinks.ellipse_ring()), sinks.polygon("ring"), ["incident_id", "scenario", "minutes", "area_ha"])
    parts = fire.spread.agreement_outlines(prints, (kind,)).join(named, "cluster")
    placed = parts.withColumn("polygon", fire.spread.grid_to_map("rings"))
    gathered = placed.groupBy("cluster", "incident_id", "severity", "kind", "minutes").agg(
        F.expr(f.rnd("sum(cells * cell * cell * 100)", 1)).alias("area_ha"), F.sort_array(F.collect_list(F.struct("region", "polygon"))).alias("p")
    )
    scenarios = every.groupBy("cluster").agg(F.count("*").alias("scenario_count"))
    ordered = gathered.join(scenarios, "cluster").withColumn("parts", F.col("p.polygon")).orderBy(F.col("minutes").desc(), "cluster")
    return sinks.features(ordered, regions.multipolygon("parts"), ["incident_id", "severity", "kind", "minutes", "area_ha", "scenario_count"])


@query("layer_projections")
def layer_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of every scenario and horizon."""
    return projections(spark, sf_dir, "scenarios")


@query("layer_envelope")
def layer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where any scenario reaches, for every incident and horizon."""
    return projections(spark, sf_dir, "envelope")


@query("layer_core")
def layer_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all scenarios agree on, for every incident and horizon; incidents without such ground do not appear."""
    return projections(spark, sf_dir, "core")


@query("geojson_points", "SELECT count(*) AS features, sum(n) AS coordinates FROM (SELECT 2 AS n FROM mem)")
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as GeoJSON text, read back."""
    text = sinks.features(clustered(spark, sf_dir), sinks.point(), ["id", "frp_mw"])
    back = text.select(F.from_json("feature", "geometry struct<coordinates: array<double>>").alias("f"))
    return back.agg(F.count("*").alias("features"), F.sum(F.size("f.geometry.coordinates")).alias("coordinates"))


# Words for display.
STATUS_WORDS = {"active": "burning", "contained": "held", "controlled": "under control", "out": "out", "archived": "archived"}
SEVERITY_WORDS = {"informational": "low concern", "minor": "minor", "moderate": "moderate", "major": "serious", "critical": "critical"}


def word(column: str, words: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in words.items())} ELSE {column} END"


WHOLE = lambda x: f"CAST(CAST(floor({x} + 0.5e0) AS BIGINT) AS STRING)"
BRIEF = f"""concat('About ', {WHOLE('area_ha')}, ' ha burnt, counted from heat spots: ', {word('status', STATUS_WORDS)}, ', ', {word('severity', SEVERITY_WORDS)}, '.',
  CASE WHEN growth > 1 THEN concat(' Growing by about ', {WHOLE('growth')}, ' ha an hour.') ELSE '' END, ' Moving ', heading, ' at roughly ', {WHOLE('head_ros')}, ' m a minute.',
  CASE WHEN next IS NOT NULL THEN concat(' In its way: ', next, '.') ELSE '' END)"""
HUMAN = "CASE WHEN minutes < 90 THEN concat(" + WHOLE("minutes") + ", ' min') ELSE concat(CAST(" + f.rnd("minutes / 60e0", 1) + " AS STRING), ' h') END"


@query("brief", f"SELECT cluster, {BRIEF} AS brief FROM ({fire.spread_sql(fire.HEADLINE)}) h LEFT JOIN (SELECT cluster, string_agg(concat(name, ' in about ', {HUMAN}), '; ' ORDER BY minutes, place_no) AS next FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY minutes, place_no) AS k FROM ({fire.EXPOSED}) WHERE minutes IS NOT NULL AND downwind) WHERE k <= 3 GROUP BY cluster) USING (cluster)")
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few sentences for each incident: size, state, growth, direction, and the first three places in its way."""
    due = fire.exposed(spark, sf_dir).where("minutes IS NOT NULL AND downwind").select("cluster", F.struct("minutes", "place_no", F.concat("name", F.lit(" in about "), F.expr(HUMAN)).alias("text")).alias("t"))
    first = due.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list("t")), 1, 3).alias("t")).select("cluster", F.array_join("t.text", "; ").alias("next"))
    return fire.headline(spark, sf_dir).join(first, "cluster", "left").select("cluster", F.expr(BRIEF).alias("brief"))


CAVEATS = """concat_ws(',', CASE WHEN slope_pct = 0 THEN 'flat_ground_assumed' ELSE 'terrain_measured' END, CASE WHEN fuel IS NOT NULL THEN 'cover_mapped' ELSE 'cover_assumed' END, 'no_barriers', 'no_spotting', 'core_is_agreed', CASE WHEN far >= 50 THEN 'run_beyond_any_fire' END)"""


@query("projection_caveats", f"SELECT cluster, {CAVEATS} AS caveats FROM plane JOIN (SELECT cluster, fuel FROM cover JOIN lcover ON code = cover_code) cv USING (cluster) JOIN (SELECT cluster, max(head_ros) * 360e0 / 1000e0 AS far FROM ({fire.SCEN}) GROUP BY cluster) x USING (cluster)")
def projection_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What limits a projection, as an ordered list of codes; what was measured comes first."""
    far = fire.ensemble(spark, sf_dir).groupBy("cluster").agg((F.max("head_ros") * 360 / 1000).alias("far"))
    ground = fire.plane_fit(spark, sf_dir).select("cluster", "slope_pct")
    return ground.join(fire.land_cover(spark, sf_dir).select("cluster", "fuel"), "cluster").join(far, "cluster").select("cluster", F.expr(CAVEATS).alias("caveats"))


@query("incident_list", f"SELECT incident_id, severity, status, area_ha, verdict, {f.format_area('area_ha')} AS area_text FROM inc JOIN judged USING (cluster) WHERE NOT is_suspect ORDER BY {f.severity_rank('severity')} DESC, area_ha DESC, cluster")
def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents(spark, sf_dir).join(plausibility(spark, sf_dir).select("cluster", "verdict", "is_suspect"), "cluster").where("NOT is_suspect")
    ordered = found.orderBy(F.expr(f.severity_rank("severity")).desc(), F.col("area_ha").desc(), "cluster")
    return ordered.select("incident_id", "severity", "status", "area_ha", "verdict", F.expr(f.format_area("area_ha")).alias("area_text"))


@query("dossier", "SELECT inc.incident_id, inc.severity, verdict, slope_pct, cover_code, (SELECT count(*) FROM mem WHERE mem.cluster = inc.cluster) AS detections FROM inc JOIN judged USING (cluster) JOIN plane USING (cluster) WHERE inc.cluster = (SELECT min(cluster) FROM inc)")
def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything on one incident, looked up by its id: here the one of the smallest label."""
    found = incidents(spark, sf_dir)
    wanted = found.orderBy("cluster").limit(1).select("cluster")
    parts = plausibility(spark, sf_dir).select("cluster", "verdict", "cover_code")
    one = found.join(F.broadcast(wanted), "cluster", "left_semi").join(parts, "cluster").join(fire.plane_fit(spark, sf_dir), "cluster")
    return one.select("incident_id", "severity", "verdict", "slope_pct", "cover_code", F.col("detection_count").alias("detections"))


@query("frp_colour", f"SELECT id, {f.heat_colour('frp_mw', 0)} AS red, {f.heat_colour('frp_mw', 1)} AS green, {f.heat_colour('frp_mw', 2)} AS blue, {f.rnd('220e0 + sqrt(frp_mw) * 90e0', 1)} AS radius_m, {f.rnd('greatest(0.15e0, 1e0 - ((SELECT now FROM nowh) - hours) / 48e0)', 3)} AS opacity FROM det")
def frp_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = f.num(adapters.now_hours(spark, sf_dir))
    return adapters.detections(spark, sf_dir).withColumn("t", F.expr(f.heat_share("frp_mw"))).select(
        "id", *(F.expr(f.heat_colour("frp_mw", i, "t")).alias(c) for i, c in enumerate(("red", "green", "blue"))), F.expr(f.rnd("220e0 + sqrt(frp_mw) * 90e0", 1)).alias("radius_m"), F.expr(f.rnd(f"greatest(0.15e0, 1e0 - ({now} - hours) / 48e0)", 3)).alias("opacity"),
    )


@query("spread_vector", f"SELECT cluster, {f.rnd('latitude + head_ros * 60 / 1000e0 * cos(radians(direction)) / 111.32e0', 4)} AS to_lat, {f.rnd('longitude + head_ros * 60 / 1000e0 * sin(radians(direction)) / (111.32e0 * cos(radians(latitude)))', 4)} AS to_lon FROM ({fire.spread_sql(fire.HEADLINE)})")
def spread_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the head is after an hour."""
    return fire.headline(spark, sf_dir).select("cluster", F.expr(f.rnd("latitude + head_ros * 60 / 1000e0 * cos(radians(direction)) / 111.32e0", 4)).alias("to_lat"), F.expr(f.rnd("longitude + head_ros * 60 / 1000e0 * sin(radians(direction)) / (111.32e0 * cos(radians(latitude)))", 4)).alias("to_lon"))


@query("format_lead", f"SELECT m AS minutes, {f.format_lead('m')} AS lead FROM (SELECT unnest(range(0, 900, 7)) * 1e0 AS m)")
def format_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 900, 7).select((F.col("id") * 1.0).alias("minutes")).select("minutes", F.expr(f.format_lead("minutes")).alias("lead"))
