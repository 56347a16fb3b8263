"""Queries on reading: feeds, payloads, fixtures, dimensions; each with the DuckDB SQL for it where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.plans.oracles import values
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters, feeds, readers
from cinderlake.storage import shared_dir

query = Registry()

# Events as lines of a feed, with the defects that feeds have.
LINE = """concat_ws(',', CAST(latitude AS STRING), CAST(longitude AS STRING), CASE WHEN id % 7 = 0 THEN '' ELSE '310.5' END, CASE id % 5 WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' ELSE '0.5' END, '0.4',
  CASE WHEN id % 37 = 0 THEN '2024-13-01' ELSE '2024-01-15' END, CAST(id % 24 * 100 + id % 60 AS STRING), CASE id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'N20' WHEN 2 THEN 'Terra' ELSE '?' END,
  CASE id % 6 WHEN 0 THEN 'l' WHEN 1 THEN 'h' WHEN 2 THEN 'nominal' WHEN 3 THEN '12' WHEN 4 THEN '80' ELSE 'junk' END, '', CAST(frp_mw AS STRING), CASE id % 3 WHEN 0 THEN 'D' WHEN 1 THEN ' d ' ELSE '' END)"""

FEED_SQL = """SELECT id, latitude, longitude, '2024-01-15 ' || lpad((id % 24)::VARCHAR, 2, '0') || ':' || lpad((id % 60)::VARCHAR, 2, '0') AS observed,
  CASE id % 4 WHEN 0 THEN 'viirs_snpp' WHEN 1 THEN 'viirs_noaa20' WHEN 2 THEN 'modis_terra' ELSE 'unknown' END AS satellite, CASE id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 3 THEN 'low' WHEN 4 THEN 'high' ELSE 'nominal' END AS confidence,
  CASE WHEN id % 7 <> 0 THEN 310.5e0 END AS brightness_k, CASE WHEN id % 5 NOT IN (1, 2) THEN 0.5e0 END AS scan_km, frp_mw, id % 3 <> 2 AS is_daytime FROM alldet WHERE id % 37 <> 0"""


@query("firms_parse", FEED_SQL)
def firms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a feed to detections: dates, numbers, satellites, confidence and day flag, bad rows dropped."""
    lines = adapters.all_detections(spark, sf_dir).select("id", F.expr(LINE).alias("line"))
    # Exploding an array of one keeps Spark from parsing the line again for every field that is read of it.
    rows = lines.select("id", F.explode(F.array(F.from_csv("line", readers.FEED))).alias("r")).select("id", "r.*")
    parsed = readers.parse_feed(rows.withColumnRenamed("id", "ord"), "unknown")
    return parsed.select(F.col("ord").alias("id"), "latitude", "longitude", F.date_format("observed_at", "yyyy-MM-dd HH:mm").alias("observed"), "satellite", "confidence", "brightness_k", "scan_km", "frp_mw", "is_daytime")


# The feed's products by satellite, and a box and days to ask for.
PRODUCT = "CASE satellite WHEN 'viirs_snpp' THEN 'VIIRS_SNPP_NRT' WHEN 'viirs_noaa20' THEN 'VIIRS_NOAA20_NRT' WHEN 'viirs_noaa21' THEN 'VIIRS_NOAA21_NRT' ELSE 'MODIS_NRT' END"
BOX = "latitude BETWEEN 36e0 AND 40e0 AND longitude BETWEEN 21e0 AND 26e0"
DAYS = "day BETWEEN DATE '2024-01-06' AND DATE '2024-01-25'"


def event_days(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    first, last = adapters.table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    return (first.date().isoformat(), last.date().isoformat()) if first else ("2024-01-02", "2024-01-01")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as files of a feed, one folder for each product and day, opened through the feed's data source."""
    root = f"{shared_dir(spark)}/cinderlake-feed-{uuid.uuid4().hex}"
    lines = adapters.all_detections(spark, sf_dir).select(
        F.expr(PRODUCT).alias("product"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day"), "latitude", "longitude", F.lit("310.5").alias("bright_ti4"), F.lit("290.1").alias("bright_ti5"),
        F.col("scan_km").alias("scan"), F.lit("0.4").alias("track"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("acq_date"), F.date_format(F.timestamp_micros("us"), "HHmm").alias("acq_time"),
        F.lit("").alias("satellite"), F.lit("n").alias("confidence"), F.col("frp_mw").alias("frp"), F.when(F.col("is_daytime"), "D").otherwise("N").alias("daynight"),
    )
    lines.repartition("product", "day").write.partitionBy("product", "day").option("header", True).csv(root)
    feeds.register(spark)
    first, last = event_days(spark, sf_dir)
    return spark.read.format("cinder_detections").options(url=root + "/product={product}/day={day}", first_day=first, last_day=last).load()


@query(
    "feed_pushdown",
    f"""SELECT product, latitude, longitude, strftime(date_trunc('minute', make_timestamp(us)), '%Y-%m-%d %H:%M') AS observed, frp_mw, is_daytime, scan_km FROM (SELECT *, {PRODUCT} AS product, make_timestamp(us)::DATE AS d FROM alldet)
  WHERE product IN ('VIIRS_SNPP_NRT', 'VIIRS_NOAA20_NRT', 'VIIRS_NOAA21_NRT') AND {DAYS.replace('day', 'd')} AND {BOX}""",
)
def feed_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the feed's products over some days and a box: only their requests are made."""
    asked = feed(spark, sf_dir).where(F.col("product").isin("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT")).where(DAYS).where(BOX)
    found = readers.parse_feed(asked.drop("day"), "viirs_noaa20")
    return found.select("product", "latitude", "longitude", F.date_format("observed_at", "yyyy-MM-dd HH:mm").alias("observed"), "frp_mw", "is_daytime", "scan_km")


def weather_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly weather as a service's answers, one file of payloads for each square degree, opened through its data source."""
    root = f"{shared_dir(spark)}/cinderlake-weather-{uuid.uuid4().hex}"
    hourly = adapters.hourly_weather(spark, sf_dir).withColumn("longitude", F.expr(adapters.LONGITUDE.replace("user_id", "site")) / 1000.0)
    at = F.date_format(F.timestamp_micros(F.col("hour") * 3_600_000_000 + adapters.EPOCH_US), "yyyy-MM-dd'T'HH:mm")
    fields = {"time": at, "temperature_2m": F.col("temperature_c"), "relative_humidity_2m": F.col("humidity_pct"), "wind_speed_10m": F.col("wind_kmh"), "wind_direction_10m": F.col("wind_from_deg"), "precipitation": F.col("rain_mm")}
    packed = hourly.groupBy("site", "latitude", "longitude").agg(F.sort_array(F.collect_list(F.struct("hour", *(c.alias(n) for n, c in fields.items())))).alias("r"))
    payload = F.to_json(F.struct("site", "latitude", "longitude", F.struct(*(F.col(f"r.{n}").alias(n) for n in fields)).alias("hourly")), {"ignoreNullFields": "false"})
    tiles = packed.select(F.floor("latitude").alias("south"), F.floor("longitude").alias("west"), payload.alias("value"))
    tiles.repartition("south", "west").write.partitionBy("south", "west").text(root)
    feeds.register(spark)
    first, last = event_days(spark, sf_dir)
    box = f"{dims.AOI_WEST},{dims.AOI_SOUTH},{dims.AOI_EAST},{dims.AOI_NORTH}"
    return spark.read.format("cinder_weather").options(url=root + "/south={south}/west={west}", first_day=first, last_day=last, box=box).load()


@query(
    "weather_pushdown",
    f"""SELECT site, hour, temperature_c, humidity_pct, wind_kmh, wind_from_deg, rain_mm FROM (SELECT *, (CASE WHEN site % 10 = 0 THEN 23300 + site * 53 % 80 * 10 ELSE 20000 + site * 53 % 900 * 10 END) / 1000e0 AS longitude, make_timestamp(hour * 3600000000 + 1704067200000000)::DATE AS d FROM wx)
  WHERE {DAYS.replace('day', 'd')} AND {BOX}""",
)
def weather_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of some days in a box: only the square degrees that the box touches are asked for, and only those days."""
    asked = weather_service(spark, sf_dir).where(DAYS).where(BOX)
    hour = F.floor((F.unix_micros(F.col("at").cast("timestamp")) - adapters.EPOCH_US) / 3_600_000_000)
    return asked.select("site", hour.alias("hour"), "temperature_c", "humidity_pct", "wind_kmh", "wind_from_deg", "rain_mm")


CONFIDENCES = ("l", "LOW", "h", " high ", "n", "nominal", "0", "29.9", "30", "79", "80", "100", "", "junk")


@query("confidence_norm", "SELECT raw, CASE WHEN lower(trim(raw)) IN ('l', 'low') THEN 'low' WHEN lower(trim(raw)) IN ('h', 'high') THEN 'high' WHEN try_cast(raw AS DOUBLE) < 30 THEN 'low' WHEN try_cast(raw AS DOUBLE) >= 80 THEN 'high' ELSE 'nominal' END AS confidence FROM (VALUES " + values([(c,) for c in CONFIDENCES]) + ") t(raw)")
def confidence_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CONFIDENCES], "raw string").select("raw", readers.confidence("raw").alias("confidence"))


PRODUCTS = "product AS ord_p, CASE product WHEN 0 THEN 0e0 WHEN 1 THEN 0.00001e0 ELSE 0.02e0 END AS nudge"


@query(
    "dedupe_first",
    f"""SELECT id, product, frp_mw FROM (SELECT *, row_number() OVER (PARTITION BY {f.rnd('latitude', 4)}, {f.rnd('longitude', 4)}, us // 60000000 ORDER BY product, id) AS k FROM (
  SELECT id, product, latitude + CASE product WHEN 0 THEN 0e0 WHEN 1 THEN 1e-5 ELSE 2e-2 END AS latitude, longitude, us, frp_mw FROM det, (VALUES (0), (1), (2)) p(product))) WHERE k = 1""",
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products that overlap: of the same place and minute the first product's detection stays."""
    base = adapters.detections(spark, sf_dir)
    shift = {0: 0.0, 1: 1e-5, 2: 2e-2}
    parts = [base.select("id", F.lit(p).alias("product"), (F.col("latitude") + s).alias("latitude"), "longitude", F.timestamp_micros("us").alias("observed_at"), "frp_mw") for p, s in shift.items()]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return readers.first_of_duplicates(union, ["product", "id"]).select("id", "product", "frp_mw")


@query("weather_fixture", f"SELECT hour, {f.rnd('24e0 + 12e0 * greatest(0e0, d)', 2)} AS temperature_c, {f.rnd('greatest(12e0, 62e0 - 40e0 * greatest(0e0, d))', 2)} AS humidity_pct, {f.rnd('18e0 + 14e0 * greatest(0e0, d)', 2)} AS wind_kmh FROM (SELECT hour, sin((hour % 24 - 9) / 24e0 * 2e0 * pi()) AS d FROM (SELECT unnest(range(0, 96)) AS hour))")
def weather_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.diurnal_weather(spark).select("hour", "temperature_c", "humidity_pct", "wind_kmh")


COVER_PAYLOAD = """CASE id % 4 WHEN 0 THEN concat('{"results":[{"attributes":{"Raster.CODE_18":"', CAST(300 + id % 30 AS STRING), '"}}]}') WHEN 1 THEN concat('{"results":[{"attributes":{"Code_18":"n/a"}},{"attributes":{"value":"', CAST(200 + id % 50 AS STRING), '"}}]}') WHEN 2 THEN '{"results":[]}' ELSE '{"oops"' END"""


@query("land_cover_parse", "SELECT id, code, fuel FROM (SELECT id, CASE id % 4 WHEN 0 THEN (300 + id % 30)::VARCHAR WHEN 1 THEN (200 + id % 50)::VARCHAR ELSE '' END AS code FROM det) LEFT JOIN lcover USING (code)")
def land_cover_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes out of a service's JSON answers, and the fuel of each."""
    answers = adapters.detections(spark, sf_dir).select("id", F.expr(COVER_PAYLOAD).alias("payload"))
    coded = answers.select("id", readers.cover_code(F.col("payload")).alias("code"))
    return coded.join(F.broadcast(dims.land_cover(spark)), "code", "left").select("id", "code", "fuel")


SCENE_ITEM = """concat('{"id":"S', CAST(id AS STRING), '","properties":{"cloud":', CAST(id % 90 AS STRING), ',"grid":"G', CAST(user_id % 5 AS STRING), '","boa_offset_applied":', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, '},"assets":{"red":{},"swir16":{},"swir22":{},"scl":{}', CASE WHEN id % 3 = 0 THEN '' ELSE ',"nir":{"scale":0.0001,"offset":-0.1}' END, '}}')"""


@query("scene_parse", "SELECT 'S' || id AS id, (id % 90)::DOUBLE AS cloud, 'G' || (user_id % 5) AS grid, 0.0001e0 AS scale, CASE WHEN id % 2 = 0 THEN 0e0 ELSE -0.1e0 END AS \"offset\" FROM det WHERE id % 3 <> 0")
def scene_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.detections(spark, sf_dir).select(F.expr(SCENE_ITEM).alias("item"))
    return items.select(readers.parse_scene(F.col("item")).alias("s")).where("s IS NOT NULL").select("s.*")


@query("source_status", "SELECT * FROM (VALUES ('detections', 'live', true), ('elevation', 'fixture', false)) t(name, mode, healthy)")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source that can be read and one whose service is away."""

    def away() -> DataFrame:
        raise OSError("service is away")

    feeds = [readers.Source("detections", "events", lambda: adapters.table(spark, sf_dir, "events"), away), readers.Source("elevation", "none", away, lambda: spark.range(0).toDF("n"))]
    for feed in feeds:
        feed.fetch()
    rows = feeds[0].status(spark).unionByName(feeds[1].status(spark))
    return rows.select("name", "mode", (F.col("mode") == "live").alias("healthy"))


@query("ontology", "SELECT * FROM (VALUES " + values([(k, i, v) for k, vs in dims.VOCABULARIES.items() for i, v in enumerate(vs)]) + ") t(vocabulary, place, value)")
def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.frame(spark, [(k, i, v) for k, vs in dims.VOCABULARIES.items() for i, v in enumerate(vs)], "vocabulary string, place int, value string")


@query("overlay_catalogue", "SELECT id, category, concat('layer=', coalesce(layer, id), CASE WHEN time_aware THEN concat('&time=', (SELECT strftime(make_timestamp(max(epoch_us(ts))), '%Y-%m-%d') FROM events)) ELSE '' END) AS tile_query, count(*) OVER (PARTITION BY category) AS in_category FROM overlay")
def overlay_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays with the query of their tiles on the current day, which is that of the newest event."""
    from pyspark.sql import Window

    today = F.date_add(F.to_date(F.lit("2024-01-01")), int(adapters.now_hours(spark, sf_dir) // 24)).cast("string")
    tile = F.concat(F.lit("layer="), F.coalesce("layer", "id"), F.when(F.col("time_aware"), F.concat(F.lit("&time="), today)).otherwise(""))
    return dims.overlays(spark).select("id", "category", tile.alias("tile_query"), F.count("*").over(Window.partitionBy("category")).alias("in_category"))
