"""Regions of cells, their outlines, hulls and dense clusters, against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake import catalog
from cinderlake.operators import cluster, hulls, regions, spread
from cinderlake.plans import layer_queries


def flood(cells):
    """By cell the first cell of its 4-connected region."""
    out = {}
    for start in sorted(cells):
        if start not in out:
            todo = [start]
            while todo:
                p = todo.pop()
                if p in cells and p not in out:
                    out[p] = start
                    todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    return out


def inside(x, y, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
            odd = not odd
    return odd


RASTERS = {(name, kind): {(r, c) for r in range(13) for c in range(11) if random.Random(f"{name}{kind}{r}{c}").random() < share} for name, kind, share in (("a", 1, 0.4), ("a", 2, 0.6), ("b", 1, 0.8), ("b", 2, 1.0), (None, 1, 0.5))}


@pytest.mark.parametrize("tile", [3, 256])
def test_regions_and_their_polygons(spark, tile):
    """The rings of a region hold its cells and no others, whether or not tiles cut it."""
    rows = [(n, k, r - 5, c - 5) for (n, k), cells in RASTERS.items() for r, c in cells]
    labelled = regions.label(spark.createDataFrame(rows + rows[:50], "name string, kind int, row int, col int"), ["name", "kind"], tile)
    got = {}
    for r in labelled.collect():
        got.setdefault((r["name"], r["kind"]), {})[r["row"] + 5, r["col"] + 5] = r["region"]
    found = {}
    for r in regions.polygons(regions.rings(labelled, ["name", "kind"], tile), ["name", "kind"]).withColumn("sides", regions.perimeter("rings")).collect():
        found.setdefault((r["name"], r["kind"]), {})[r["region"]] = r
    for raster, cells in RASTERS.items():
        if raster[0] is None and raster not in got:
            continue
        want = flood(cells)
        names = {p: (f[0] - 5) * regions.ROW_STEP + f[1] - 5 for p, f in want.items()}
        assert got[raster] == names
        for region in set(names.values()):
            mine = {p for p, x in names.items() if x == region}
            polygon = found[raster][region]
            rings = [[x.asDict() for x in ring] for ring in polygon["rings"]]
            covered = {(r, c) for r in range(-1, 14) for c in range(-1, 12) if sum(inside(c - 4.5, r - 4.5, ring) for ring in rings) % 2}
            assert covered == mine and polygon["cells"] == len(mine) and polygon["holes"] == len(rings) - 1
            assert all(len({(x["x"], x["y"]) for x in ring}) == len(ring) for ring in rings)
            assert polygon["sides"] == sum((r + i, c + j) not in mine for r, c in mine for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_small_grids_are_traced_where_their_cells_are_found(spark):
    """Rings of bounded grids are those of the general way by tiles, found row by row in as many tasks as there are, and not a group of Python for each grid."""
    r = random.Random(5)
    rows = [(k // 9, k % 9, r.choice([0.0, r.uniform(1, 30)]), r.uniform(0, 5), r.uniform(1, 4), r.choice([None, r.uniform(0, 360)]), 60) for k in range(9 * 40)]
    prints = spark.createDataFrame(rows, "cluster long, scenario_no int, head_ros double, back_ros double, lb double, direction double, minutes int")
    keys = ["cluster", "minutes", "cell", "kind"]
    traced = spread.agreement_rings(prints)
    assert traced.select(F.spark_partition_id()).distinct().count() == 4 and "FlatMapGroupsInArrow" not in traced._jdf.queryExecution().toString()
    cells = []
    for row in spread.agreement_rows(prints).collect():
        shapes = {c: np.array([math.nan if x[c] is None else x[c] for x in row["shapes"]]) for c in spread.SHAPE}
        n = spread.hits(row["cell"], shapes, spread.GRID_STEPS)
        for kind, some in (("envelope", n > 0), ("core", n == len(row["shapes"]))):
            cells += [(row["cluster"], row["minutes"], row["cell"], kind, int(i), int(j)) for i, j in zip(*some.nonzero(), strict=True)]
    general = regions.rings(regions.label(spark.createDataFrame(cells, "cluster long, minutes int, cell double, kind string, row long, col long"), keys), keys)
    sides = [*keys, "region", "cells", "holes", "corners", "rings"]
    want = sorted(map(str, regions.polygons(general, keys).select(*sides).collect()))
    assert sorted(map(str, regions.polygons(traced, keys).select(*sides).collect())) == want and len(want) > 40
    counted = {x["cluster"]: (x["envelope_cells"], x["core_cells"]) for x in spread.agreement(prints).collect()}
    assert counted == {k: tuple(sum(c[0] == k and c[3] == kind for c in cells) for kind in ("envelope", "core")) for k in range(40)}


def test_no_cells_have_no_regions(spark):
    none = regions.label(spark.createDataFrame([], "site long, row int, col int"), ["site"])
    assert none.count() == 0 and regions.polygons(regions.rings(none, ["site"]), ["site"]).count() == 0


def test_partial_hulls_make_the_hull(spark, monkeypatch):
    monkeypatch.setattr(hulls, "MOST_CORNERS", 5)
    r = random.Random(4)
    points = [(k, r.gauss(0, 1), r.gauss(0, 1)) for k in (1, 2, None) for _ in range(400)] + [(3, 1.0, 1.0)] * 4 + [(4, float(i), 2.0 * i) for i in range(5)] + [(5, None, 1.0)]
    df = spark.createDataFrame(points, "k long, longitude double, latitude double").repartition(7)
    got = {row["k"]: row for row in hulls.convex_hulls(df, "k", radius=0.1).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for k in (1, 2, None):
        mine = [p[1:] for p in points if p[0] == k]
        corners = hulls.hull_of(mine)
        assert got[k]["n"] == 400 and got[k]["corners"] == len(corners)
        assert all(hulls.turn(a, b, p) >= -1e-12 for a, b in zip(corners, corners[1:] + corners[:1], strict=True) for p in mine)
        ring = [(p["x"], p["y"]) for p in got[k]["ring"]]
        # The area within a distance of a convex shape, and less than a thousandth off for corners in place of arcs.
        area = got[k]["hull_area"] + got[k]["hull_length"] * 0.1 + math.pi * 0.01
        assert hulls.ring_area(ring) == pytest.approx(area, rel=1e-3) and hulls.ring_area(ring) <= area
    assert (got[3]["hull_area"], got[3]["hull_length"], got[3]["corners"]) == (0, 0, 1)
    assert got[4]["corners"] == 2 and got[4]["hull_length"] == pytest.approx(2 * math.dist((0, 0), (4, 8)))


def test_layers_of_projections_hold_the_area_they_tell(spark, sf):
    every = {kind: [json.loads(r["feature"]) for r in layer_queries.projections(spark, sf, kind).collect()] for kind in ("envelope", "core", "scenarios")}
    assert every["envelope"] and every["core"] and every["scenarios"]
    for kind in ("envelope", "core"):
        minutes = [f["properties"]["minutes"] for f in every[kind]]
        assert minutes == sorted(minutes, reverse=True)
        for f in every[kind]:
            total = 0.0
            for polygon in f["geometry"]["coordinates"]:
                lat = polygon[0][0][1]
                for ring in polygon:
                    assert ring[0] == ring[-1]
                    total += hulls.ring_area([(x * 111.32 * math.cos(math.radians(lat)), y * 111.32) for x, y in ring[:-1]]) * 100
            assert total == pytest.approx(f["properties"]["area_ha"], rel=0.01, abs=0.1) and f["properties"]["scenario_count"] == 9
    one = every["envelope"][0]["properties"]["incident_id"]
    only = layer_queries.projections(spark, sf, "envelope", one).collect()
    assert {json.loads(r["feature"])["properties"]["incident_id"] for r in only} == {one}
    assert layer_queries.projections(spark, sf, "core", "none such").count() == 0
    with pytest.raises(ValueError, match="kind"):
        layer_queries.projections(spark, sf, "outline")


def brute_clusters(points, eps_km, eps_hours):
    over = {p[0]: p[0] for p in points}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    linked = set()
    for i, (a, ax, ay, ah) in enumerate(points):
        for b, bx, by, bh in points[:i]:
            if (ax - bx) ** 2 + (ay - by) ** 2 <= eps_km**2 and abs(ah - bh) <= eps_hours:
                linked |= {a, b}
                x, y = sorted((top(a), top(b)))
                over[y] = x
    return {p[0]: top(p[0]) if p[0] in linked else -1 for p in points}


@pytest.mark.parametrize(("few", "spread"), [(4096, 12.0), (4, 12.0), (4, 3.5), (1, 25.0)])
def test_cells_link_as_their_points_do(spark, monkeypatch, few, spread):
    """Whether cells are compared point by point or cut finer first, the clusters are those of all pairs of points."""
    monkeypatch.setattr(cluster, "FEW_PAIRS", few)
    r = random.Random(int(spread * 10) + few)
    points = [(i, r.uniform(0, spread), r.uniform(0, spread), r.choice([0.0, 30.0, r.uniform(0, 90)])) for i in range(160)]
    points += [(200 + i, 3.0 * i, 40.0, 0.0) for i in range(5)] + [(300 + i, 60.0, 60.0, 30.0 * i) for i in range(4)] + [(400, 90.0, 90.0, 0.0)]
    df = spark.createDataFrame(points, "id long, x double, y double, h double")
    got = {row["id"]: row["cluster"] for row in cluster.placed_clusters(df).collect()}
    assert got == brute_clusters(points, 3.0, 30.0)


def test_two_dense_cells_out_of_reach_stay_apart(spark):
    """Thousands of points just out of reach of each other are told apart without comparing all pairs."""
    near = spark.range(3000).select("id", (F.rand(1) * 0.5).alias("x"), (F.rand(2) * 2).alias("y"), (F.rand(3) * 10).alias("h"))
    far = spark.range(3000, 6000).select("id", (F.rand(4) * 0.5 + 3.6).alias("x"), (F.rand(5) * 2).alias("y"), (F.rand(6) * 10).alias("h"))
    sizes = cluster.placed_clusters(near.unionByName(far)).groupBy("cluster").count().collect()
    assert sorted((r["cluster"], r["count"]) for r in sizes) == [(0, 3000), (3000, 3000)]


def test_registered_layers_read_the_tables(spark, sf):
    for name in ("layer_envelope", "layer_core", "layer_perimeters"):
        assert catalog.QUERIES[name](spark, sf).count() > 0
