"""Clusters kept up to date as detections come in, late ones too, and what becomes of incidents' ids.

A batch is not clustered with all that is known, but with the known detections near its own. Known clusters are nodes, so a batch can
join several of them; the smallest id goes on as the label. A late detection may be earlier than the anchor that an incident
has its id from: the old id and the new one are written down. Detections that leave the window go, and the clusters that lose
some are clustered anew from what is left of them, as they may fall apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.operators import cluster
from cinderlake.operators.graph import FEW_LINKS, components
from cinderlake.storage import Stored

#: One projection for all batches, as distances must not depend on what else is in a batch.
MIDDLE_LATITUDE = (dims.AOI_SOUTH + dims.AOI_NORTH) / 2
MEMBER = "id long, us long, latitude double, longitude double, cluster long"


def placed(points: DataFrame) -> DataFrame:
    """Adds x and y in km and h in hours to points with latitude, longitude and us."""
    k = F.lit(cluster.KM_PER_RADIAN_DEGREE)
    return points.withColumns({"x": F.col("longitude") * k * F.cos(F.radians(F.lit(MIDDLE_LATITUDE))), "y": F.col("latitude") * k, "h": F.col("us") / 3.6e9})


def absorb(known: DataFrame, fresh: DataFrame, oldest_us: int) -> DataFrame:
    """``MEMBER`` rows of the known and the fresh detections from ``oldest_us`` on. Of ids that come again the known row stays."""
    kept = known.where(F.col("us") >= oldest_us)
    torn = known.where((F.col("us") < oldest_us) & (F.col("cluster") >= 0)).select("cluster").distinct()
    whole = kept.join(torn, "cluster", "left_anti")
    again = kept.join(torn, "cluster", "left_semi").select("id", "us", "latitude", "longitude")
    new = fresh.where(F.col("us") >= oldest_us).select("id", "us", "latitude", "longitude").dropDuplicates(["id"]).join(kept.select("id"), "id", "left_anti")
    both = whole.select("id", "us", "latitude", "longitude", "cluster", F.lit(False).alias("fresh")).unionByName(new.unionByName(again).withColumns({"cluster": F.lit(-1).cast("long"), "fresh": F.lit(True)}))
    at = Stored(placed(both), "absorbed").df
    cell = {"cx": F.floor(F.col("x") / dims.EPS_KM), "cy": F.floor(F.col("y") / dims.EPS_KM), "ch": F.floor(F.col("h") / dims.EPS_HOURS)}
    celled = at.withColumns(cell)
    near = celled.where("fresh").select("cx", "cy", "ch").distinct()
    for c in cell:
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    touched = celled.join(near.distinct(), [*cell], "left_semi")
    # What is linked among the touched detections ties their known clusters; a lone detection is a node of its own.
    local = cluster.placed_clusters(touched.select("id", "x", "y", "h")).withColumnRenamed("cluster", "group")
    node = F.when(F.col("cluster") >= 0, F.col("cluster")).otherwise(F.col("id")).alias("node")
    ties = touched.select("id", node).join(local.where(F.col("group") >= 0), "id").select(F.col("group").alias("a"), F.col("node").alias("b"))
    joined = Stored(components(ties, at_once=FEW_LINKS), "joined").df
    # A group of which all detections are one node has no tie; it is then a single known cluster and stays as it is.
    named = at.withColumn("node", node).join(joined, "node", "left")
    return named.select("id", "us", "latitude", "longitude", F.coalesce("component", "cluster").alias("cluster"))


def incident_ids(members: DataFrame) -> DataFrame:
    """``(cluster, incident_id)`` by the first detection of each cluster."""
    first = members.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.min_by(F.struct("latitude", "longitude", "us"), F.struct("us", "id")).alias("anchor"))
    return first.select("cluster", cluster.incident_id().alias("incident_id"))


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(old_id, new_id)`` of incidents whose id is no more; where one falls apart or is out of the window there are several rows or a null."""
    old, new = incident_ids(before), incident_ids(after)
    was = before.where(F.col("cluster") >= 0).select("id", F.col("cluster").alias("was"))
    now = after.where(F.col("cluster") >= 0).select("id", "cluster")
    went = was.join(now, "id", "left").groupBy("was", "cluster").agg(F.count("*").alias("n"))
    named = went.join(old.select(F.col("cluster").alias("was"), F.col("incident_id").alias("old_id")), "was").join(new.select("cluster", F.col("incident_id").alias("new_id")), "cluster", "left")
    gone = named.groupBy("old_id").agg(F.array_sort(F.collect_set("new_id")).alias("ids"))
    return gone.where(~F.array_contains("ids", F.col("old_id"))).select("old_id", F.explode_outer("ids").alias("new_id"))


def keep_clusters(stream: DataFrame, detections: Callable[[DataFrame], DataFrame], path: str, days: int = dims.DAY_WINDOW, once: bool = False, every: str = "15 minutes"):
    """Starts a stream that keeps ``MEMBER`` rows under ``path``, a new folder for each batch, and the renamed incidents beside them.

    A batch reads the folder of the one before it and its own rows only, so what it costs follows the window, not all that ever came; readers of
    an earlier folder are not disturbed. A batch that is repeated after a failure writes the same folder again.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], MEMBER)
        known = members(spark, path, number - 1) if number else empty
        fresh = detections(batch).select("id", "us", "latitude", "longitude").persist()
        newest = fresh.agg(F.max("us")).unionByName(known.agg(F.max("us"))).agg(F.max("max(us)")).first()[0]
        absorb(known, fresh, (newest or 0) - days * 86_400_000_000 + 1).write.mode("overwrite").parquet(f"{path}/members/batch={number}")
        fresh.unpersist()
        renamed(known, members(spark, path, number)).write.mode("overwrite").parquet(f"{path}/renamed/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()


def members(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(MEMBER).parquet(f"{path}/members/batch={number}")
