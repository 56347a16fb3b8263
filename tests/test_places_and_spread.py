import pytest
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import geo, raster, spread, terrain
from cinderlake.sources import generator, readers, sinks

INSIDE = [("Kastellorizo", 36.146, 29.594), ("Gavdos", 34.833, 24.083), ("Othonoi", 39.843, 19.396), ("Samos", 37.755, 26.977), ("Rhodes", 36.434, 28.218), ("Soufli", 41.193, 26.297)]
OUTSIDE = [("Izmir", 38.420, 27.140), ("Tirana", 41.330, 19.820), ("Skopje", 41.990, 21.430), ("Sofia", 42.700, 23.320), ("Bursa", 40.190, 29.060), ("Denizli", 37.862, 29.372)]


def test_boundary(spark):
    rows = [(n, a, o) for n, a, o in INSIDE + OUTSIDE] + [(p[0], p[1], p[2]) for p in dims.PLACES]
    got = geo.within_boundary(spark.createDataFrame(rows, "name string, latitude double, longitude double"), dims.boundary_edges(spark)).where("NOT inside").collect()
    assert {r["name"] for r in got} == {n for n, *_ in OUTSIDE}


def test_no_outline_keeps_all(spark):
    one = spark.createDataFrame([(0.0, 0.0)], "latitude double, longitude double")
    assert geo.within_boundary(one, dims.boundary_edges(spark).limit(0)).first()["inside"]


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").first()["v"]


def test_scalars(spark):
    assert value(spark, f.haversine_km("38e0", "23e0", "38e0", "23e0")) == 0
    assert value(spark, f.haversine_km("37.9838e0", "23.7275e0", "40.6401e0", "22.9444e0")) == pytest.approx(303, abs=2)
    assert value(spark, f.bearing_deg("38e0", "23e0", "39e0", "23e0")) == 0
    assert value(spark, f.compass_point("359e0")) == "N" and value(spark, f.compass_point("46e0")) == "NE"
    assert value(spark, f.slope_wind_kmh("52e0")) == pytest.approx(31.99, abs=0.01)
    assert value(spark, f.angle_between("10e0", "350e0")) == 20
    assert [value(spark, f.format_area(f.num(x))) for x in (12.34, 2742.0, 12345.0)] == ["12.3 ha", "2,742 ha", "12.3k ha"]
    assert [value(spark, f.format_lead(f.num(x))) for x in (12, 100, 487)] == ["10 min", "1.5 h", "8 h"]


def estimate(spark, **over):
    row = {"isi": 15.0, "wind": 30.0, "wind_from": 0.0, "slope": 0.0, "aspect": None, "moist": 1.0, "fuel": "maquis"} | over
    df = spark.createDataFrame([tuple(row.values())], "isi double, wind double, wind_from double, slope double, aspect double, moist double, fuel string")
    return spread.estimate(spread.with_fuel(df, dims.fuels(spark), "fuel")).first()


def test_spread_follows_wind_and_hill(spark):
    calm, strong = estimate(spark, wind=10.0), estimate(spark)
    assert strong["direction"] == 180 and strong["lb"] > calm["lb"] and strong["head_ros"] >= strong["back_ros"]
    hill = estimate(spark, wind=2.0, slope=50.0, aspect=90.0)
    assert 80 < hill["direction"] < 110
    assert estimate(spark, fuel="no such fuel")["head_ros"] == strong["head_ros"]
    assert estimate(spark, isi=-5.0)["head_ros"] == 0


def test_ensemble_invariants(spark, sf):
    from cinderlake.plans import fire_queries as q

    flat = spark.createDataFrame([(1, 38.1, 23.8, 92.0, 10.0, 30.0, 0.0, 0.0, None, "pine", None)], "cluster long, latitude double, longitude double, ffmc double, day_isi double, wind_kmh double, wind_from_deg double, slope_pct double, aspect_deg double, fuel string, ndmi double")
    by = {r["scenario"]: r for r in spread.scenario_spread(flat, dims.scenarios(spark), dims.fuels(spark), dims.moisture_ranges(spark)).collect()}
    assert len(by) == 9 and by["easing"]["head_ros"] < by["expected"]["head_ros"] < by["gusting"]["head_ros"]
    assert by["light_fuel"]["fuel_used"] == "phrygana" and by["expected"]["fuel_used"] == "pine" and by["veer_left"]["direction"] == 150
    for r in spread.agreement(spread.footprints(q.ensemble(spark, sf))).collect():
        assert r["core_ha"] <= r["envelope_ha"]


def test_downwind_place_scores_above_upwind(spark):
    rows = [("down", "settlement", 5.0, 180.0, 1000), ("up", "settlement", 5.0, 0.0, 1000)]
    near = spark.createDataFrame(rows, "name string, kind string, km double, bearing double, population long").selectExpr("*", "180e0 AS direction", "20e0 AS head_ros", "3e0 AS lb")
    got = {r["name"]: r for r in spread.exposure(near).collect()}
    assert got["down"]["downwind"] and not got["up"]["downwind"] and got["down"]["threat"] > got["up"]["threat"]


def test_plane(spark):
    samples = terrain.sample_grid(spark.createDataFrame([(1,)], "cluster long")).withColumn("z", F.lit(500.0) + F.col("i") * 400 * 0.2 + F.col("j") * 400 * 0.0)
    r = terrain.plane_fit(samples).first()
    assert (r["slope_pct"], r["aspect_deg"], r["relief_m"]) == (20.0, 90.0, 320.0)


def test_patches_are_four_connected(spark):
    cells = [(0, 0), (0, 1), (1, 1), (2, 2)]
    df = spark.createDataFrame([(1, r, c, 0.3, False) for r, c in cells], "site long, row int, col int, dnbr double, water boolean")
    assert sorted(r["n"] for r in raster.patches(df).groupBy("patch").agg(F.count("*").alias("n")).collect()) == [1, 3]


def test_feed_file_and_rejection(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,bright_ti5,frp,daynight\n38.1,23.9,330,0.4,0.4,2026-08-27,935,N,n,290,12.5,D\nbad,23.9,330,0.4,0.4,2026-08-27,935,N,n,290,12.5,D\n")
    rows = readers.read_feed(spark, str(good)).collect()
    assert len(rows) == 1 and rows[0]["satellite"] == "viirs_snpp" and str(rows[0]["observed_at"]) == "2026-08-27 09:35:00"
    bad = tmp_path / "bad.csv"
    bad.write_text("Invalid key ABCDEFGHIJKLMNOP1234\n")
    source = readers.Source("feed", "x", lambda: readers.read_feed(spark, str(bad)), lambda: spark.range(0).toDF("n"))
    assert source.fetch().count() == 0 and source.mode == "fixture" and "ABCDEFGHIJKLMNOP" not in source.note


def test_fixture_is_shifted(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text('{"anchor": "2024-08-11T00:00:00Z", "detections": [{"latitude": 38.0, "longitude": 23.0, "observed_at": "2024-08-10T12:00:00Z", "frp_mw": 3.0}]}')
    r = readers.shifted_fixture(spark, str(path), "2026-01-02T00:00:00Z").first()
    assert str(r["observed_at"]) == "2026-01-01 12:00:00" and r["satellite"] == "viirs_noaa20"


def test_hull(spark):
    pts = spark.createDataFrame([(1, x, y) for x, y in [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (1.0, 1.0), (1.0, 0.0)]], "cluster long, longitude double, latitude double")
    ring = [(p["lon"], p["lat"]) for p in sinks.convex_hull(pts).first()["ring"]]
    assert ring[0] == ring[-1] and set(ring) == {(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)}


def test_geojson_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 38.0, 23.0)], "id long, latitude double, longitude double")
    sinks.write_features(sinks.features(rows, sinks.point(), ["id"]), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["geometry"]["coordinates"] == [23.0, 38.0]


def test_generator_is_deterministic(spark):
    a, b = (sorted(map(tuple, generator.fires(s).collect())) for s in (spark, spark))
    assert a == b and len(a) > 500


def test_http_source_reads_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    spark.dataSource.register(readers.RetryingHttp)
    got = spark.read.format("cinder_http").option("urls", f"file://{tmp_path}/x.txt").load().collect()
    assert [r["line"] for r in got] == ["one", "two"]


def test_area_index_equals_the_plain_fold(spark, tmp_path):
    """Points by the index of cells and by all edges of a file with several parts and a hole; no file or a broken one keeps all points."""
    import json
    import math
    import random

    from cinderlake.operators import areas, geo

    r = random.Random(8)
    star = [[23 + math.cos(k / 9 * math.pi) * (1 + k % 2 * 0.6), 38 + math.sin(k / 9 * math.pi) * (1 + k % 2 * 0.6)] for k in range(18)]
    hole = [[22.8, 37.8], [23.2, 37.8], [23.2, 38.2], [22.8, 38.2], [22.8, 37.8]]
    island = [[25.01, 37.0], [25.02, 37.0], [25.02, 37.01], [25.01, 37.0]]
    feature = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[star + star[:1], hole], [island]]}}
    path = tmp_path / "area.geojson"
    path.write_text(json.dumps(feature, indent=1))
    edges = areas.load_edges(spark, str(path))
    assert edges.count() == 18 + 4 + 3
    rows = [(i, r.uniform(36.2, 39.8), r.uniform(21, 25.2)) for i in range(3000)] + [(5000, 37.003, 25.018), (5001, 38.0, 23.0), (5002, None, 23.0)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    for margin in (0.0, 5.0):
        plain = {x["id"] for x in geo.within_boundary(points.where("latitude IS NOT NULL"), edges, margin).where("inside").collect()}
        for cell in (0.1, 0.37):
            assert {x["id"] for x in areas.AreaIndex(edges, margin, cell).mark(points).where("inside").collect()} == plain
        assert 0 < len(plain) < 2000 and 5000 in plain and 5001 not in plain
    (tmp_path / "broken.geojson").write_text('{"type": "Feature", "geometry": {"type": "Poly')
    for missing in ("broken.geojson", "none.geojson"):
        none = areas.load_edges(spark, str(tmp_path / missing))
        assert none.count() == 0 and areas.AreaIndex(none).mark(points).where("inside").count() == len(rows)
    one = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [island]}}]}
    (tmp_path / "one.geojson").write_text(json.dumps(one))
    assert areas.load_edges(spark, str(tmp_path / "one.geojson")).count() == 3
