"""Queries on detections and incidents, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions import formulas as f
from cinderlake.operators import cluster
from cinderlake.operators.ranking import numbered
from cinderlake.plans.oracles import sql
from cinderlake.plans.picture import clustered, incidents, plausibility
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters

query = Registry()


@query("neighbour_edges", "SELECT a, b FROM edge")
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbours(cluster.project(adapters.detections(spark, sf_dir)))


@query("st_dbscan", "SELECT id, cluster FROM label")
def st_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.st_dbscan(adapters.detections(spark, sf_dir))


CORES = """core AS (SELECT a AS id FROM twoway GROUP BY a HAVING count(*) >= 3), cedge AS (SELECT a, b FROM twoway SEMI JOIN core ON core.id = a SEMI JOIN core c ON c.id = b),
creach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, t.b FROM creach r JOIN cedge t ON t.a = r.other), clabel AS (SELECT id, min(other) AS cluster FROM creach GROUP BY id)"""


@query("st_dbscan_min_samples_4")
def st_dbscan_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more samples asked for, points at the border of a cluster are not core."""
    return cluster.st_dbscan(adapters.detections(spark, sf_dir), min_samples=4)


query.oracles["st_dbscan_min_samples_4"] = sql("SELECT a FROM twoway, det").rsplit("\n", 1)[0] + f""", {CORES}
SELECT id, coalesce(any_value(clabel.cluster), min(n.cluster), -1) AS cluster FROM det LEFT JOIN clabel USING (id) LEFT JOIN twoway t ON t.a = det.id LEFT JOIN clabel n ON n.id = t.b GROUP BY det.id"""


@query("noise", "SELECT id, latitude, longitude FROM mem WHERE cluster = -1")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).where("cluster = -1").select("id", "latitude", "longitude")


@query("cluster_stats", "SELECT count(*) AS detections, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS clusters, count(*) FILTER (cluster < 0) AS noise FROM mem")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).agg(F.count("*").alias("detections"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise"))


SUMMARY = "cluster, detection_count, area_ha, growth, total_frp, max_frp, status, severity, score"


@query("incident_summary", f"SELECT {SUMMARY} FROM inc")
def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).select(*SUMMARY.split(", "))


@query("frp_centroid", "SELECT cluster, latitude, longitude FROM inc")
def frp_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).select("cluster", "latitude", "longitude")


@query("cell_area", "SELECT cluster, area_ha FROM area")
def cell_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cell_area(clustered(spark, sf_dir).where("cluster >= 0"))


@query("incident_id", "SELECT cluster, incident_id FROM inc")
def incident_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).select("cluster", "incident_id")


@query("picture_order", f"SELECT row_number() OVER (ORDER BY {f.severity_rank('severity')} DESC, area_ha DESC, cluster) AS place, cluster, severity, area_ha, status FROM inc")
def picture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: incidents ranked by severity and area."""
    found = incidents(spark, sf_dir).select("cluster", "severity", "area_ha", "status")
    placed = numbered(found, [F.expr(f.severity_rank("severity")).desc(), F.col("area_ha").desc(), F.col("cluster")])
    return placed.select("place", "cluster", "severity", "area_ha", "status").orderBy("place")


@query(
    "picture_totals",
    f"SELECT count(*) FILTER (status = 'active') AS active_count, {f.rnd('sum(area_ha)', 1)} AS total_area_ha, count(*) FILTER (NOT is_suspect) AS total_incidents, count(*) FILTER (is_suspect) AS suspect_count FROM inc JOIN judged USING (cluster)",
)
def picture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active fires and area are over all incidents, the number of incidents over those not suspect."""
    both = incidents(spark, sf_dir).join(plausibility(spark, sf_dir).select("cluster", "is_suspect"), "cluster")
    return both.agg(F.count_if(F.col("status") == "active").alias("active_count"), F.expr(f.rnd("sum(area_ha)", 1)).alias("total_area_ha"), F.count_if(~F.col("is_suspect")).alias("total_incidents"), F.count_if("is_suspect").alias("suspect_count"))


SIGNALS = "cluster, n, peak_frp, median_frp, night_fraction, days, span_h, spread_km, satellites"


@query("plausibility_signals", f"SELECT {SIGNALS} FROM sig")
def plausibility_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.signals(clustered(spark, sf_dir)).select(*SIGNALS.split(", "))


@query("plausibility", "SELECT cluster, cover_code, verdict, plausibility, is_suspect FROM judged")
def plausibility_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plausibility(spark, sf_dir).select("cluster", "cover_code", "verdict", "plausibility", "is_suspect")


@query("status_filter", "SELECT cluster, status, area_ha FROM inc WHERE status = 'active' AND area_ha >= 50")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).where("status = 'active' AND area_ha >= 50").select("cluster", "status", "area_ha")


@query("suspect_filter", "SELECT cluster, verdict FROM judged WHERE NOT is_suspect")
def suspect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plausibility(spark, sf_dir).where("NOT is_suspect").select("cluster", "verdict")


@query(
    "imaging_gate",
    "SELECT cluster, CASE WHEN n < 3 THEN 'too few detections' WHEN verdict = 'likely_not_wildfire' THEN 'not a fire' WHEN (SELECT now FROM nowh) - first_h < 12 THEN 'too soon' ELSE 'image' END AS gate, NOT (n >= 3 AND verdict = 'likely_not_wildfire') AS transient FROM judged JOIN inc0 USING (cluster)",
)
def imaging_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why no image of an incident is asked for; the first reason that holds."""
    now = adapters.now_hours(spark, sf_dir)
    both = plausibility(spark, sf_dir).join(incidents(spark, sf_dir).select("cluster", "first_h"), "cluster")
    gate = F.expr(f"CASE WHEN n < 3 THEN 'too few detections' WHEN verdict = 'likely_not_wildfire' THEN 'not a fire' WHEN {f.num(now)} - first_h < 12 THEN 'too soon' ELSE 'image' END")
    return both.select("cluster", gate.alias("gate"), F.expr("NOT (n >= 3 AND verdict = 'likely_not_wildfire')").alias("transient"))
