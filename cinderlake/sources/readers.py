"""Readers of detection feeds, weather, land cover and scene lists, with a fixture to fall back on and a status row.

Feeds are read as text and parsed by expressions, so a bad row yields nulls that are filtered, and never a failed job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cinderlake import dims
from cinderlake.functions import formulas as f

FEED = "latitude string, longitude string, brightness string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, second string, frp string, daynight string"
# What a feed answers instead of rows.
REJECTIONS = ("invalid", "you have exceeded")


def number(c: str) -> Column:
    """A double, or null for what is empty, not a number or NaN."""
    cast = F.expr(f"try_cast(nullif(trim({c}), '') AS double)")
    return F.when(~F.isnan(cast), cast)


def confidence(c: str) -> Column:
    raw = f"lower(trim({c}))"
    return F.expr(f"CASE WHEN {raw} IN ('l', 'low') THEN 'low' WHEN {raw} IN ('h', 'high') THEN 'high' WHEN try_cast({raw} AS double) < 30 THEN 'low' WHEN try_cast({raw} AS double) >= 80 THEN 'high' ELSE 'nominal' END")


def satellite(c: str, default: str) -> Column:
    alias = " ".join(f"WHEN {a!r} THEN {s!r}" for a, s in dims.SATELLITE_ALIASES)
    return F.expr(f"CASE lower(trim({c})) {alias} ELSE {default!r} END")


def parse_feed(rows: DataFrame, default_satellite: str) -> DataFrame:
    """Detections of a feed's string columns; rows without a position or a valid time are dropped."""
    at = F.expr("try_to_timestamp(concat(trim(acq_date), ' ', lpad(trim(acq_time), 4, '0')), 'yyyy-MM-dd HHmm')")
    parsed = rows.select(
        number("latitude").alias("latitude"), number("longitude").alias("longitude"), at.alias("observed_at"), satellite("satellite", default_satellite).alias("satellite"),
        number("frp").alias("frp_mw"), number("brightness").alias("brightness_k"), number("second").alias("brightness_k_secondary"), confidence("confidence").alias("confidence"),
        number("scan").alias("scan_km"), number("track").alias("track_km"), F.coalesce(F.upper(F.trim("daynight")) == "D", F.lit(False)).alias("is_daytime"), *(c for c in rows.columns if c in ("ord", "product")),
    )
    return parsed.where("observed_at IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")


def read_feed(spark: SparkSession, path: str, default_satellite: str = "viirs_noaa20") -> DataFrame:
    """A feed file with a header. The two sensors name brightness columns differently; both are taken."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if len(raw.columns) < 2 or raw.columns[0].strip().lower().startswith(REJECTIONS):
        raise ValueError(f"the feed answered: {raw.columns[0][:80]}")
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    named = raw.select(
        *(pick(c).alias(c) for c in ("latitude", "longitude", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "frp", "daynight")),
        pick("bright_ti4", "brightness").alias("brightness"), pick("bright_ti5", "bright_t31").alias("second"),
    )
    return parse_feed(named, default_satellite)


def first_of_duplicates(detections: DataFrame, order: list[str]) -> DataFrame:
    """Detections of several products without duplicates: same place to 4 decimals and minute; the first by ``order``."""
    key = [F.expr(f.rnd("latitude", 4)).alias("klat"), F.expr(f.rnd("longitude", 4)).alias("klon"), F.date_trunc("minute", "observed_at").alias("kmin")]
    best = detections.groupBy(*key).agg(F.min_by(F.struct(*detections.columns), F.struct(*order)).alias("d"))
    return best.select("d.*")


def shifted_fixture(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Recorded detections, moved so that their anchor falls on ``now``."""
    raw = spark.read.option("multiLine", True).json(path)
    each = raw.select(F.to_timestamp("anchor").alias("anchor"), F.explode("detections").alias("d")).select("anchor", "d.*")
    moved = F.timestamp_micros(F.unix_micros(F.to_timestamp("observed_at")) + F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("anchor"))
    filled = {"satellite": "viirs_noaa20", "confidence": "nominal", "scan_km": 0.375, "track_km": 0.375, "is_daytime": True}
    out = each.withColumn("observed_at", moved).drop("anchor")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v) for c, v in filled.items()})


def diurnal_weather(spark: SparkSession, start_hour: int = 0, hours: int = 96) -> DataFrame:
    """Stand-in weather: a dry summer day's swing of temperature, humidity and wind; no rain."""
    swing = "sin((hour % 24 - 9) / 24e0 * 2e0 * pi())"
    n = spark.range(start_hour, start_hour + hours).withColumnRenamed("id", "hour")
    return n.select(
        "hour", F.expr(f.rnd(f"24e0 + 12e0 * greatest(0e0, {swing})", 2)).alias("temperature_c"), F.expr(f.rnd(f"greatest(12e0, 62e0 - 40e0 * greatest(0e0, {swing}))", 2)).alias("humidity_pct"),
        F.expr(f.rnd(f"18e0 + 14e0 * greatest(0e0, {swing})", 2)).alias("wind_kmh"), F.lit(25.0).alias("wind_from_deg"), F.expr(f.rnd(f"30e0 + 22e0 * greatest(0e0, {swing})", 2)).alias("gust_kmh"), F.lit(0.0).alias("rain_mm"),
    )


COVER_SCHEMA = "results array<struct<attributes: map<string, string>>>"


def cover_code(payload: Column) -> Column:
    """The land-cover code of a service's answer: the first ``Raster.CODE_18``, else the first code of digits only."""
    parsed = F.from_json(payload, COVER_SCHEMA)["results"]
    first = F.get(F.filter(F.transform(parsed, lambda r: r["attributes"]["Raster.CODE_18"]), lambda c: F.coalesce(c, F.lit("")) != ""), 0)
    other = F.transform(parsed, lambda r: F.coalesce(r["attributes"]["Code_18"], r["attributes"]["value"], F.lit("")))
    return F.coalesce(first, F.get(F.filter(other, lambda c: c.rlike("^[0-9]+$")), 0), F.lit(""))


SCENE_SCHEMA = "struct<id: string, bbox: array<double>, properties: struct<cloud: double, grid: string, boa_offset_applied: boolean>, assets: map<string, struct<href: string, scale: double, `offset`: double>>>"
SCENE_BANDS = ("red", "nir", "swir16", "swir22", "scl")


def parse_scene(item: Column) -> Column:
    """Id, cloud, grid and calibration of a scene; null unless all five bands are there.

    An offset that the provider has applied already counts as zero; the class band is never scaled.
    """
    s = F.from_json(item, SCENE_SCHEMA)
    whole = F.size(F.array_intersect(F.map_keys(s["assets"]), F.array(*map(F.lit, SCENE_BANDS)))) == len(SCENE_BANDS)
    nir = s["assets"]["nir"]
    offset = F.when(F.coalesce(s["properties"]["boa_offset_applied"], F.lit(False)), F.lit(0.0)).otherwise(F.coalesce(nir["offset"], F.lit(-0.1)))
    return F.when(whole, F.struct(s["id"].alias("id"), s["properties"]["cloud"].alias("cloud"), s["properties"]["grid"].alias("grid"), F.coalesce(nir["scale"], F.lit(0.0001)).alias("scale"), offset.alias("offset")))


class Source:
    """A live reader with a fixture behind it: ``fetch`` never raises, ``status`` says which of them served."""

    def __init__(self, name: str, attribution: str, live: Callable[[], DataFrame], fixture: Callable[[], DataFrame]) -> None:
        self.name, self.attribution, self.live, self.fixture = name, attribution, live, fixture
        self.mode, self.note = "unused", ""

    def fetch(self) -> DataFrame:
        try:
            found = self.live()
            found.limit(1).count()
            self.mode, self.note = "live", ""
            return found
        except Exception as error:  # whatever a feed does, the fixture serves
            self.mode, self.note = "fixture", redacted(str(error).splitlines()[0][:200] if str(error) else type(error).__name__)
            return self.fixture()

    def status(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, self.mode, self.attribution, self.note)], "name string, mode string, attribution string, note string")


def redacted(text: str) -> str:
    """A message without what looks like a key: runs of 16 letters and digits or more."""
    return re.sub(r"[A-Za-z0-9]{16,}", "***", text)


class RetryingHttp(DataSource):
    """``spark.read.format("cinder_http")``: the lines behind a URL, fetched by executors with three attempts each."""

    @classmethod
    def name(cls) -> str:
        return "cinder_http"

    def schema(self) -> str:
        return "url string, line string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.urls = [u for u in options.get("urls", options.get("path", "")).split("|") if u]
        self.wait = float(options.get("wait", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        import urllib.request

        url = partition.value
        for attempt in range(3 if url else 0):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    for line in answer.read().decode("utf-8").splitlines():
                        yield url, line
                return
            except OSError:
                if attempt == 2:
                    raise
                time.sleep(min(10.0, self.wait * 2**attempt))
