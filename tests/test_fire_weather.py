import pytest

from cinderlake.functions import formulas as f
from cinderlake.operators import weather


def series(spark, days):
    rows = [(1, i, *map(float, d[:4]), d[4], float(d[5])) for i, d in enumerate(days)]
    return weather.fire_weather(spark.createDataFrame(rows, "site long, day long, temperature_c double, humidity_pct double, wind_kmh double, day_rain double, month int, latitude double")).first()


def test_published_day(spark):
    r = series(spark, [(17, 42, 25, 0, 4, 46)])
    assert [r[c] for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")] == pytest.approx([87.69, 8.55, 19.01, 10.85, 8.49, 10.10], abs=0.01)


def test_dry_spell_raises_drought_and_rain_lowers_it(spark):
    dry = series(spark, [(35, 20, 20, 0, 7, 38)] * 30)
    wet = series(spark, [(35, 20, 20, 0, 7, 38)] * 30 + [(20, 90, 5, 40, 7, 38)])
    assert dry["dc"] > 5 * 15 and wet["dc"] < dry["dc"] and wet["ffmc"] < dry["ffmc"] and wet["dmc"] < dry["dmc"]


@pytest.mark.parametrize(("x", "name"), [(0, "very_low"), (5.2, "low"), (11.2, "moderate"), (21.3, "high"), (38, "very_high"), (50, "extreme")])
def test_danger_thresholds(spark, x, name):
    assert spark.sql(f"SELECT {f.danger_class(f.num(x))} AS c").first()["c"] == name


def test_days_without_noon_reading_are_left_out(spark):
    rows = [(1, h, 0, h % 24, 20.0, None if h == 10 else 30.0, 5.0, 0.0, 1.0, 7, 38.0) for h in (8, 10)]
    hourly = spark.createDataFrame(rows, "site long, hour long, day long, hour_of_day long, temperature_c double, humidity_pct double, wind_kmh double, wind_from_deg double, rain_mm double, month int, latitude double")
    assert weather.daily_inputs(hourly).count() == 0


def test_incidents_ask_for_the_weather_of_their_sites_only(spark, sf, monkeypatch, tmp_path):
    """Exposure and scenarios group and fold the weather of sites that have an incident, and get of it what all sites' weather holds."""
    from cinderlake.plans import fire_queries, picture
    from cinderlake.sources import adapters

    events = adapters.table(spark, sf, "events")
    lone = events.orderBy("ts", ascending=False).limit(1).selectExpr("event_id + 1000000 AS event_id", "ts", "1001L AS user_id", *events.columns[3:])
    events.unionByName(lone).write.parquet(f"{tmp_path}/events.parquet")
    asked, plain = [], weather.daily_inputs
    monkeypatch.setattr(weather, "daily_inputs", lambda hourly: asked.append(hourly) or plain(hourly))
    found = fire_queries.local_weather(spark, str(tmp_path)).select("cluster", "site").collect()
    sites = {r["user_id"] for r in picture.clustered(spark, str(tmp_path)).where("id = cluster").collect()}
    every = [tuple(r) for r in adapters.hourly_weather(spark, str(tmp_path)).collect()]
    got = [tuple(r) for r in asked[0].collect()]
    assert found and {r["site"] for r in found} <= sites and 1001 in {r[0] for r in every} - sites
    assert sorted(map(repr, got)) == sorted(repr(r) for r in every if r[0] in sites)
