"""Detection feeds and weather services as data sources that ask only for what a query needs.

``spark.read.format("cinder_detections")`` has a partition for each product and day, ``cinder_weather`` one for each square
degree. Filters on product, day and position reach ``pushFilters`` before partitions are made: they take partitions away and
narrow the box and the days of each request. Addresses are templates, of a service (``https:``) or of files in any store that
pyarrow reads; a folder stands for the files in it. Each executor fetches its own partitions, with three attempts.
"""

from __future__ import annotations

import csv
import io
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cinderlake.shipping import ship
from cinderlake.sources.readers import REJECTIONS, redacted

ATTEMPTS = 3
#: Products of the feed and what satellite a row without one is of.
PRODUCTS = {"VIIRS_SNPP_NRT": "viirs_snpp", "VIIRS_NOAA20_NRT": "viirs_noaa20", "VIIRS_NOAA21_NRT": "viirs_noaa21", "MODIS_NRT": "modis_terra"}
HOURLY = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "precipitation")


class Unreachable(RuntimeError):
    """A service or file that did not answer; the text names no key."""


def bodies(address: str, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """The texts behind an address: one of a service, or those of a file or folder; none where there is no such file."""
    for attempt in range(ATTEMPTS):
        try:
            if re.match("https?:", address):
                import urllib.request

                with urllib.request.urlopen(address, timeout=30) as answer:
                    return [answer.read().decode("utf-8")]
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(address)
            found = store.get_file_info(path)
            if found.type == fs.FileType.NotFound:
                return []
            names = [path] if found.type == fs.FileType.File else sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
            return [store.open_input_stream(n).read().decode("utf-8") for n in names]
        except OSError as error:
            # What the service refuses for good is not asked again.
            if attempt == ATTEMPTS - 1 or (400 <= getattr(error, "code", 0) < 500 and error.code != 429):  # type: ignore[attr-defined]
                raise Unreachable(redacted(f"{address}: {error}")) from None
            sleep(min(10.0, wait * 2**attempt))
    return []


class Wanted:
    """What filters leave of products, days and the box (west, south, east, north)."""

    def __init__(self, products: list[str], first: date, last: date, box: tuple[float, float, float, float]) -> None:
        self.products, self.first, self.last, self.box = products, first, last, list(box)

    def days(self) -> list[date]:
        return [self.first + timedelta(i) for i in range((self.last - self.first).days + 1)]

    def take(self, condition: Filter) -> bool:
        """Narrows by a condition; whether nothing of it is left to check on the rows."""
        name = condition.attribute[0] if len(getattr(condition, "attribute", ())) == 1 else None
        value = getattr(condition, "value", None)
        if name == "product" and isinstance(condition, (EqualTo, In)):
            values = {value} if isinstance(condition, EqualTo) else {*condition.value}
            self.products = [p for p in self.products if p in values]
            return True
        if name == "day" and isinstance(condition, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, date):
            if isinstance(condition, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, value + timedelta(isinstance(condition, GreaterThan)))
            if isinstance(condition, (EqualTo, LessThanOrEqual, LessThan)):
                self.last = min(self.last, value - timedelta(isinstance(condition, LessThan)))
            return True
        if name in ("latitude", "longitude") and isinstance(value, (int, float)):
            low = 1 if name == "latitude" else 0
            if isinstance(condition, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.box[low] = max(self.box[low], value)
            if isinstance(condition, (EqualTo, LessThan, LessThanOrEqual)):
                self.box[low + 2] = min(self.box[low + 2], value)
        return False  # a box is asked for, and positions are checked again

    def holds(self, longitude: float, latitude: float) -> bool:
        return self.box[0] <= longitude <= self.box[2] and self.box[1] <= latitude <= self.box[3]


class PushdownReader(DataSourceReader):
    """Reads what ``Wanted`` leaves. Subclasses make partitions of it and read them."""

    def __init__(self, options, products: list[str]) -> None:
        self.address, self.key, self.wait = options["url"], options.get("key", ""), float(options.get("wait", "1"))
        box = tuple(map(float, options.get("box", "-180,-90,180,90").split(",")))
        asked = [p for p in options.get("products", ",".join(products)).split(",") if p]
        self.wanted = Wanted(asked, date.fromisoformat(options["first_day"]), date.fromisoformat(options["last_day"]), box)  # type: ignore[arg-type]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if not self.wanted.take(condition):
                yield condition

    def fetch(self, **names: object) -> list[str]:
        address = self.address.format(key=self.key, area=",".join(f"{c:.4f}" for c in self.wanted.box), **names)
        try:
            return bodies(address, self.wait)
        except Unreachable as error:
            raise Unreachable(str(error).replace(self.key, "***") if self.key else str(error)) from None


class DetectionReader(PushdownReader):
    """One request for each product and day. A refusal in place of rows gives none."""

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, d)) for p in self.wanted.products for d in self.wanted.days()] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        product, day = partition.value
        for body in self.fetch(product=product, day=day.isoformat()):
            if body.lstrip().lower().startswith(REJECTIONS):
                continue
            for row in csv.DictReader(io.StringIO(body)):
                at = [as_number(row.get(c)) for c in ("latitude", "longitude")]
                if None in at or not self.wanted.holds(at[1], at[0]):
                    continue
                text = [row.get(c) for c in ("scan", "track", "acq_date", "acq_time", "satellite", "confidence", "frp", "daynight")]
                yield (product, day, *at, row.get("bright_ti4") or row.get("brightness"), row.get("bright_ti5") or row.get("bright_t31"), *text)


class WeatherReader(PushdownReader):
    """One request for each square degree of the box; its answer has a payload of parallel arrays for each place in a line."""

    def partitions(self) -> list[InputPartition]:
        west, south, east, north = self.wanted.box
        if west > east or south > north or self.wanted.first > self.wanted.last:
            return [InputPartition(None)]
        return [InputPartition((i, j)) for i in range(int(south // 1), int(north // 1) + 1) for j in range(int(west // 1), int(east // 1) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        i, j = partition.value
        for body in self.fetch(south=i, west=j, first_day=self.wanted.first.isoformat(), last_day=self.wanted.last.isoformat()):
            for line in body.splitlines():
                payload = json.loads(line)
                place = payload["latitude"], payload["longitude"]
                hourly = payload.get("hourly") or {}
                if not self.wanted.holds(place[1], place[0]):
                    continue
                for k, at in enumerate(hourly.get("time", [])):
                    day = date.fromisoformat(at[:10])
                    if self.wanted.first <= day <= self.wanted.last:
                        values = [(hourly.get(c) or [])[k : k + 1] for c in HOURLY]
                        yield (payload.get("site"), *place, day, datetime.fromisoformat(at), *(v[0] if v else None for v in values))


def as_number(text: str | None) -> float | None:
    try:
        x = float(text or "")
    except ValueError:
        return None
    return x if abs(x) <= 180 else None  # NaN too


class Detections(DataSource):
    """Options: ``url`` with {key}, {product}, {area} and {day}; ``first_day``, ``last_day``; ``products``, ``box`` and ``key`` where not all are meant."""

    @classmethod
    def name(cls) -> str:
        return "cinder_detections"

    def schema(self) -> str:
        return "product string, day date, latitude double, longitude double, brightness string, second string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, frp string, daynight string"

    def reader(self, schema) -> DetectionReader:
        return DetectionReader(self.options, [*PRODUCTS])


class Weather(DataSource):
    """Options: ``url`` with {south}, {west}, {first_day} and {last_day}; ``first_day``, ``last_day``; ``box``."""

    @classmethod
    def name(cls) -> str:
        return "cinder_weather"

    def schema(self) -> str:
        hours = "temperature_c double, humidity_pct double, wind_kmh double, wind_from_deg double, gust_kmh double, rain_mm double"
        return f"site long, latitude double, longitude double, day date, at timestamp_ntz, {hours}"

    def reader(self, schema) -> WeatherReader:
        return WeatherReader(self.options, [])


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, with filters reaching them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Detections, Weather):
        spark.dataSource.register(source)
