import hashlib
import math
from datetime import UTC, datetime, timedelta

import pytest

from cinderlake.operators import cluster

SCHEMA = "id long, us long, hours double, latitude double, longitude double, frp_mw double, satellite string, scan_km double, is_daytime boolean, day long"


def points(spark, rows):
    full = [(i, int(h * 3.6e9), float(h), lat, lon, 50.0, "viirs_snpp", 0.375, True, int(h // 24)) for i, (lat, lon, h) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows, **bounds):
    return [r["cluster"] for r in cluster.st_dbscan(points(spark, rows), **bounds).orderBy("id").collect()]


def test_two_fires_and_noise(spark):
    assert labels(spark, [(38.2, 23.9, 0), (38.21, 23.9, 1), (39.5, 22.0, 0), (39.51, 22.0, 2), (36.0, 28.0, 0)]) == [0, 0, 2, 2, -1]


def test_an_overpass_gap_is_bridged_and_a_longer_one_is_not(spark):
    assert labels(spark, [(38.2, 23.9, 0), (38.2, 23.9, 30)]) == [0, 0]
    assert labels(spark, [(38.2, 23.9, 0), (38.2, 23.9, 30.1)]) == [-1, -1]


def test_near_in_space_alone_is_not_enough(spark):
    assert labels(spark, [(38.2, 23.9, 0), (38.2, 23.9, 50), (38.3, 23.9, 0)]) == [-1, -1, -1]


def test_border_point_joins_the_smallest_cluster_and_is_not_core(spark):
    line = [(38.0 + 0.02 * i, 23.9, 0) for i in range(4)]
    assert labels(spark, line, min_samples=3) == [1, 1, 1, 1]
    assert labels(spark, line[:2], min_samples=3) == [-1, -1]


def test_empty_and_single(spark):
    assert labels(spark, []) == [] and labels(spark, [(38.2, 23.9, 0)]) == [-1]


@pytest.mark.parametrize("least", [3, 4, 9])
def test_denser_clusters_equal_the_plain_definition(spark, least, monkeypatch):
    """Cores, clusters and border points of thin and of dense cells as all pairs have them, without a list of all pairs."""
    import random

    monkeypatch.setattr(cluster, "neighbours", lambda *a: pytest.fail("all pairs are listed"))
    r = random.Random(least)
    rows = [(38 + r.random() * 0.5, 23 + r.random() * 0.5, r.random() * 90) for _ in range(170)] + [(38.2 + r.gauss(0, 0.01), 23.2 + r.gauss(0, 0.01), r.uniform(0, 60)) for _ in range(150)]
    rows += [(37.0, 22.0 + k * 0.02, 10.0) for k in range(12)] + [(37.0, 22.1, 40.0)] * 2
    placed = {p["id"]: p for p in cluster.project(points(spark, rows)).collect()}
    near = {i: [j for j, q in placed.items() if (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 <= 9 and abs(p["h"] - q["h"]) <= 30] for i, p in placed.items()}
    cores = {i for i, of in near.items() if len(of) >= least}
    want = {}
    for i in sorted(cores):
        todo = [i] if i not in want else []
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += [k for k in near[j] if k in cores]
    for i in placed:
        if i not in cores:
            want[i] = min((want[k] for k in near[i] if k in cores), default=-1)
    assert labels(spark, rows, min_samples=least) == [want[i] for i in range(len(rows))]
    assert -1 in want.values() and any(i not in cores and c >= 0 for i, c in want.items())


def test_points_are_compared_only_between_groups_that_boxes_leave_apart(spark, monkeypatch):
    """Two cells whose boxes leave open whether they are linked are not compared point by point where sure links by a third cell have joined them."""
    asked, plain = [], cluster.cell_links
    monkeypatch.setattr(cluster, "cell_links", lambda placed, open_, *a: asked.append(open_.select("rep", "rep2").collect()) or plain(placed, open_, *a))
    north = lambda km: 38.0 + km / 111.195
    ends = [(north(km + d), 23.0, 0.0) for km in (0.0, 2.9) for d in (-0.2, 0.0, 0.2)]
    assert labels(spark, [*ends, (north(1.45), 23.0251, 1.0)]) == [0] * 7
    assert labels(spark, ends) == [0] * 6  # without the third cell only points tell
    assert asked[0] == [] and [{r["rep"], r["rep2"]} for r in asked[1]] == [{0, 3}]


def test_clusters_do_not_travel_over_the_driver(spark):
    """What grows with the detections is joined by shuffles, so that the driver gets none of it."""
    plan = cluster.members(points(spark, [(38.2, 23.9, 0), (38.21, 23.9, 1), (36.0, 28.0, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan.replace("BroadcastNestedLoopJoin", "")


def test_grid_join_finds_all_pairs(spark):
    import random

    random.seed(3)
    rows = [(38 + random.random() * 0.3, 23 + random.random() * 0.3, random.random() * 100) for _ in range(120)]
    placed = cluster.project(points(spark, rows)).collect()
    want = {(p["id"], q["id"]) for p in placed for q in placed if p["id"] < q["id"] and math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 3 and abs(p["h"] - q["h"]) <= 30}
    got = [(r["a"], r["b"]) for r in cluster.neighbours(cluster.project(points(spark, rows))).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def cell_rows(n, repeats=1):
    """Detections at the centres of n cells of 375 m."""
    dlat = 0.375 / 111.32
    i0, out = math.floor(38.2 / dlat), []
    for k in range(n):
        lat = (i0 + k // 4 + 0.5) * dlat
        dlon = 0.375 / (111.32 * math.cos(math.radians(lat)))
        out += [(lat, (math.floor(23.9 / dlon) + k % 4 + 0.5) * dlon, 0.0)] * repeats
    return out


@pytest.mark.parametrize("repeats", [1, 5])
def test_repeats_do_not_inflate_the_area(spark, repeats):
    area = lambda n: cluster.cell_area(points(spark, cell_rows(n, repeats)).selectExpr("*", "0L AS cluster")).first()["area_ha"]
    assert area(1) == pytest.approx(14.1, abs=0.05) and area(16) == pytest.approx(225.0, abs=0.1)


def test_id_is_stable_under_row_order(spark):
    rows = [(38.2, 23.9, 3), (38.21, 23.9, 1), (38.2, 23.91, 2)]
    names = set()
    for order in (rows, rows[::-1]):
        df = points(spark, order)
        names.add(cluster.incidents(cluster.members(df), 5.0).first()["incident_id"])
    assert len(names) == 1


@pytest.mark.parametrize("micros", [0, 120_000])
def test_id_and_centroid_are_those_of_plain_python(spark, micros):
    first = datetime(2024, 8, 11, 12, 3, 5, micros, tzinfo=UTC)
    rows = [(38.2137, 23.9004, 10.0, 0), (38.2215, 23.9101, 250.0, 1), (38.2011, 23.8952, None, 2)]
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    full = []
    for i, (lat, lon, frp, h) in enumerate(rows):
        us = (first + timedelta(hours=h) - epoch) // timedelta(microseconds=1)
        full.append((i, us, us / 3.6e9, lat, lon, frp, "viirs_snpp", 0.375, True, 0))
    got = cluster.incidents(cluster.members(spark.createDataFrame(full, SCHEMA)), 1e6).first()
    weights = [max(frp or 0.0, 0.1) for _, _, frp, _ in rows]
    mean = lambda k: round(sum(w * r[k] for w, r in zip(weights, rows, strict=True)) / sum(weights), 6)
    assert got["incident_id"] == hashlib.sha1(f"38.214:23.900:{first.isoformat()}".encode()).hexdigest()[:16]
    assert (got["latitude"], got["longitude"]) == (mean(0), mean(1))


def test_small_cells_leave_the_clusters_as_they_are(spark):
    import random

    random.seed(9)
    rows = [(38 + random.gauss(0, 0.06), 23 + random.gauss(0, 0.06), random.random() * 120) for _ in range(150)] + [(38.5, 23.5, 0.0)] * 3
    placed = cluster.project(points(spark, rows)).collect()
    root = list(range(len(rows)))
    near = [(p["id"], q["id"]) for p in placed for q in placed if p["id"] < q["id"] and math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 3 and abs(p["h"] - q["h"]) <= 30]
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for pair in near for x in pair}
    assert labels(spark, rows) == [root[i] if i in linked else -1 for i in range(len(rows))]


def test_places_are_numbered_over_ranges(spark):
    from pyspark.sql import functions as F

    from cinderlake.operators.ranking import numbered

    df = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("k"))
    got = {r["id"]: r["place"] for r in numbered(df, [F.col("k").desc(), F.col("id")]).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: (-(i * 37 % 11), i)))}
    assert numbered(df.limit(0), [F.col("id")]).count() == 0


def test_threat_is_scored_by_the_rounded_distance(spark):
    from cinderlake.functions import formulas as f
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("settlement", 12.3449, None, True, 1000)], "kind string, km double, minutes double, downwind boolean, population long")
    got = row.select(F.expr(f.threat_score("kind", f.rnd("km", 2), "minutes", "downwind", "population")).alias("t")).first()["t"]
    same = row.withColumn("km", F.lit(12.34)).select(F.expr(f.threat_score("kind", "km", "minutes", "downwind", "population")).alias("t")).first()["t"]
    assert got == same


def test_patches_of_wide_rasters_stay_apart(spark):
    from cinderlake.operators import raster

    cells = [(0, 0, 24), (0, 0, 25), (0, 1, 0), (0, 1, 1), (1, 30, 2)]
    df = spark.createDataFrame([(s, r, c, 0.5, False) for s, r, c in cells], "site long, row long, col long, dnbr double, water boolean")
    got = {(x["site"], x["row"], x["col"]): x["patch"] for x in raster.patches(df).collect()}
    assert got[0, 0, 24] == got[0, 0, 25] != got[0, 1, 0] == got[0, 1, 1] and len(set(got.values())) == 3
