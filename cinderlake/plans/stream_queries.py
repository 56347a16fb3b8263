"""Streams run over all that is there, held against the same question in batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.operators import cluster, weather
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters, generator
from cinderlake.storage import shared_dir
from cinderlake.streaming import detections as live
from cinderlake.streaming import rekey, state

query = Registry()


@query("stream_daily_window", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5)::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode: every window, the open ones too."""
    return live.drain(live.daily(live.events(spark, sf_dir)), "complete")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drain(live.first_by_minute(live.events(spark, sf_dir)))


@query(
    "stream_session",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drain(live.sessions(live.events(spark, sf_dir)), "complete")


@query("stream_status", "SELECT user_id, max(epoch_us(ts)) AS last_us, count(*) AS n FROM events GROUP BY user_id")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user, from the state updates that the stream wrote."""
    updates = live.drain(live.statuses(live.events(spark, sf_dir)))
    return updates.groupBy("user_id").agg(F.max("last_us").alias("last_us"), F.max("n").alias("n"))


@query("stream_codes", "SELECT site, n_days, ffmc, dmc, dc, isi, bui, fwi FROM danger")
def stream_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire-weather codes carried from day to day by a stream that gets the days in three batches: the last row of each site."""
    path = f"{shared_dir(spark)}/cinderlake-days-{uuid.uuid4().hex}"
    daily = weather.daily_inputs(adapters.hourly_weather(spark, sf_dir))
    files = spark.sparkContext.defaultParallelism
    for low, high in ((None, 10), (10, 20), (20, None)):
        part = daily.where(F.lit(low is None) | (F.col("day") >= (low or 0))).where(F.lit(high is None) | (F.col("day") < (high or 0)))
        live.deal(part, path, files)
    days = live.dealt(spark, daily.schema, path, files)
    rows = live.drain(state.carried_codes(days))
    last = rows.groupBy("site").agg(F.max_by(F.struct("n_days", "ffmc", "dmc", "dc", "isi", "bui", "fwi"), "day").alias("r"))
    return last.select("site", "r.*")


@query(
    "stream_quiet",
    """SELECT user_id, last_us, n, status FROM (
  SELECT user_id, d, last_us, sum(k) OVER (PARTITION BY user_id, fire ORDER BY d) AS n, mark // 1000 >= last_us // 1000 + 43200000 AS contained, mark // 1000 >= last_us // 1000 + 172800000 AS gone FROM (
    SELECT *, coalesce(sum((mark // 1000 >= last_us // 1000 + 172800000)::INT) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fire FROM (
      SELECT u.*, coalesce(CASE WHEN next_d IS NULL THEN (SELECT max(mx) FROM day_mark) ELSE (SELECT max(seen) FROM day_mark m WHERE m.d > u.d AND m.d < u.next_d) END, -1) AS mark FROM (
        SELECT user_id, d, max(us) AS last_us, count(*) AS k, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS next_d FROM (SELECT user_id, us, us // 432000000000 AS d FROM alldet) GROUP BY user_id, d) u))), (VALUES ('contained'), ('out')) s(status)
  WHERE CASE status WHEN 'out' THEN gone ELSE contained END""",
)
def stream_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires found contained and out by event-time timers, the events arriving five days at a time."""
    path = f"{shared_dir(spark)}/cinderlake-daily-{uuid.uuid4().hex}"
    events = adapters.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    dated = events.withColumn("d", F.floor(F.unix_micros("at") / 432_000_000_000))
    days = [r["d"] for r in dated.select("d").distinct().orderBy("d").collect()]  # one for five days
    files = spark.sparkContext.defaultParallelism
    for day in days:
        live.deal(dated.where(F.col("d") == day).drop("d"), path, files)
    arriving = live.dealt(spark, events.schema, path, files).withWatermark("at", "0 seconds")
    return live.drain(state.quiet_fires(arriving))


@query(
    "stream_rekey",
    """SELECT id, cluster, incident_id FROM fixedlabel JOIN det USING (id) LEFT JOIN (SELECT cluster, left(sha1(concat(printf('%.3f', alat), ':', printf('%.3f', alon), ':', CASE WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f+00:00') END)), 16) AS incident_id
  FROM (SELECT cluster, arg_min(latitude, (us, id)) AS alat, arg_min(longitude, (us, id)) AS alon, min(us) AS us FROM fixedlabel JOIN det USING (id) WHERE cluster >= 0 GROUP BY cluster)) USING (cluster)""",
)
def stream_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and incident ids after three batches, a fifth of whose events come a batch late; the same as of all events at once."""
    path = f"{shared_dir(spark)}/cinderlake-rekey-{uuid.uuid4().hex}"
    events = adapters.table(spark, sf_dir, "events")
    late = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    files = spark.sparkContext.defaultParallelism
    for batch in range(3):
        live.deal(events.where(late == batch), f"{path}/in", files)
    arriving = live.dealt(spark, events.schema, f"{path}/in", files)
    rekey.keep_clusters(arriving, adapters.detections_of, path, once=True).awaitTermination()
    last = rekey.members(spark, path, 2)
    return last.select("id", "cluster").join(rekey.incident_ids(last), "cluster", "left").select("id", "cluster", "incident_id")


@query("stream_rebuild", "SELECT cluster, severity FROM inc")
def stream_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents as the last micro-batch leaves them."""
    path = f"{shared_dir(spark)}/cinderlake-rebuild-{uuid.uuid4().hex}"

    def picture(events: DataFrame) -> DataFrame:
        found = cluster.members(adapters.recent(adapters.detections_of(events)))
        return cluster.incidents(found, adapters.newest_hours(events)).select("cluster", "severity")

    live.rebuild(live.events(spark, sf_dir), picture, path, once=True).awaitTermination()
    return spark.read.parquet(f"{path}/picture")


@query("synthetic_fires")
def synthetic_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.fires(spark)
