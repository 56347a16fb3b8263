"""Data sources that ask only for what a query needs, over a small service of this machine."""

import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cinderlake.sources import feeds

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,bright_ti5,frp,daynight\n"


class Service(BaseHTTPRequestHandler):
    asked: list = []
    failures: dict = {}

    def do_GET(self):
        parts = self.path.strip("/").split("/")
        self.asked.append(parts)
        if self.failures.get(parts[0], 0) > 0:
            self.failures[parts[0]] -= 1
            return self.send_error(503)
        if parts[0] == "gone":
            return self.send_error(404)
        if parts[0] == "refused":
            body = "Invalid MAP_KEY."
        elif parts[0] == "weather":
            south, west = map(int, parts[1:3])
            place = {"site": south * 100 + west, "latitude": south + 0.5, "longitude": west + 0.5, "hourly": {"time": ["2024-01-01T23:00", "2024-01-02T00:00", "2024-01-03T05:00"], "temperature_2m": [1.5, 2.5], "precipitation": [0.0, None, 3.0]}}
            body = json.dumps(place) + "\n" + json.dumps({"site": 0, "latitude": south + 0.1, "longitude": west + 0.1})
        else:
            product, day = parts[2:4]
            body = HEADER + f"38.5,23.5,310,0.4,0.4,{day},0130,N,n,290,{len(product)},D\n38.5,29.0,310,0.4,0.4,{day},0130,N,n,290,1,D\nx,23.5,310,0.4,0.4,{day},0130,N,n,290,1,D\n"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.asked.clear()
    Service.failures.clear()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def detections(spark, url, **more):
    feeds.register(spark)
    options = {"url": url, "key": "s3cret", "first_day": "2024-01-01", "last_day": "2024-01-10", "products": "VIIRS_SNPP_NRT,MODIS_NRT", "wait": "0.01"} | more
    return spark.read.format("cinder_detections").options(**options).load()


def test_filters_take_requests_away(spark, service):
    every = detections(spark, service + "/feed/{key}/{product}/{day}/{area}")
    assert every.rdd.getNumPartitions() == 20
    few = every.where("product = 'MODIS_NRT' AND day >= DATE '2024-01-03' AND day < DATE '2024-01-06' AND longitude BETWEEN 20 AND 25 AND latitude > 38")
    assert few.rdd.getNumPartitions() == 3
    Service.asked.clear()
    rows = few.collect()
    assert sorted(p[3] for p in Service.asked) == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert {(p[1], p[2], p[4]) for p in Service.asked} == {("s3cret", "MODIS_NRT", "20.0000,38.0000,25.0000,90.0000")}
    assert [(r["day"], r["latitude"], r["longitude"], r["frp"]) for r in sorted(rows)] == [(date(2024, 1, d), 38.5, 23.5, "9") for d in (3, 4, 5)]
    assert few.where("day > DATE '2024-02-01'").count() == 0 and every.where(F.col("product").isin("OTHER")).count() == 0


def test_conditions_that_cannot_be_pushed_are_checked_on_rows(spark, service):
    df = detections(spark, service + "/feed/{key}/{product}/{day}", box="20,30,30,40")
    assert df.where("frp = '9' OR longitude = 29.0").count() == 10 + 20
    assert df.where("longitude > 28 AND day = DATE '2024-01-02'").count() == 2


def test_three_attempts_and_no_key_in_errors(spark, service):
    Service.failures["flaky"] = 2
    one = {"first_day": "2024-01-01", "last_day": "2024-01-01", "products": "MODIS_NRT"}
    assert detections(spark, service + "/flaky/{key}/{product}/{day}", **one).count() == 2
    Service.failures["down"] = 99
    with pytest.raises(Exception, match="503") as error:
        detections(spark, service + "/down/{key}/{product}/{day}", **one).count()
    assert "s3cret" not in str(error.value).split("JVM stacktrace")[0]
    assert sum(p[0] == "down" for p in Service.asked) % 3 == 0
    with pytest.raises(Exception, match="404"):
        detections(spark, service + "/gone/{key}/{product}/{day}", **one).count()
    assert len([p for p in Service.asked if p[0] == "gone"]) == sum(p[0] == "down" for p in Service.asked) // 3  # not asked again by one attempt


def test_refusals_and_missing_files_give_no_rows(spark, service, tmp_path):
    assert detections(spark, service + "/refused/{key}/{product}/{day}").count() == 0
    folder = tmp_path / "MODIS_NRT" / "2024-01-02"
    folder.mkdir(parents=True)
    for i in range(2):
        (folder / f"part-{i}.csv").write_text(HEADER.replace("bright_ti4", "brightness") + f"38.{i},23.5,31{i},0.4,0.4,2024-01-02,0130,N,n,290,1,D\n")
    (folder / "_SUCCESS").write_text("")
    rows = detections(spark, tmp_path.as_uri() + "/{product}/{day}").collect()
    assert sorted((r["latitude"], r["brightness"]) for r in rows) == [(38.0, "310"), (38.1, "311")]


def test_weather_by_square_degrees(spark, service):
    feeds.register(spark)
    url = service + "/weather/{south}/{west}/{first_day}/{last_day}"
    every = spark.read.format("cinder_weather").options(url=url, first_day="2024-01-01", last_day="2024-01-31", box="20,35,23,37").load()
    assert every.rdd.getNumPartitions() == 12
    few = every.where("latitude >= 36.2 AND latitude <= 36.9 AND longitude < 21.9 AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'")
    assert few.rdd.getNumPartitions() == 2
    Service.asked.clear()
    rows = few.collect()
    assert {tuple(p[1:]) for p in Service.asked} == {("36", "20", "2024-01-02", "2024-01-03"), ("36", "21", "2024-01-02", "2024-01-03")}
    # Arrays that are too short give nulls, and a place without hours gives no rows.
    assert sorted((r["site"], r["day"].day, r["temperature_c"], r["rain_mm"]) for r in rows if r["day"].day == 2) == [(3620, 2, 2.5, None), (3621, 2, 2.5, None)]
    assert sorted((r["site"], r["temperature_c"], r["rain_mm"]) for r in rows if r["day"].day == 3) == [(3620, None, 3.0), (3621, None, 3.0)]
