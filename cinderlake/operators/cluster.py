"""Spatio-temporal density clustering of detections into incidents.

The neighbour graph is a self-join within a radius and a time span. A grid of cells as wide as the bounds turns it
into an equi-join: each point is sent to the cells around its own, half of them by symmetry, and the exact bounds are
checked on what meets. Points of one place and time are thereby never compared with all others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators.graph import FEW_LINKS, components, tiled_components
from cinderlake.storage import Stored

KM_PER_RADIAN_DEGREE = math.pi * dims.EARTH_RADIUS_KM / 180.0


def project(points: DataFrame) -> DataFrame:
    """Adds ``x`` and ``y`` in km from the batch's mean position, and ``h`` in hours from its first detection.

    The centre is one aggregate row, joined as a broadcast of proven size one.
    """
    centre = points.agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"), F.min("hours").alias("h0"))
    k = F.lit(KM_PER_RADIAN_DEGREE)
    placed = points.crossJoin(F.broadcast(centre))
    return placed.withColumns({
        "x": (F.col("longitude") - F.col("lon0")) * k * F.cos(F.radians("lat0")),
        "y": (F.col("latitude") - F.col("lat0")) * k,
        "h": F.col("hours") - F.col("h0"),
    }).drop("lat0", "lon0", "h0")


def neighbours(points: DataFrame, eps_km: float = dims.EPS_KM, eps_hours: float = dims.EPS_HOURS) -> DataFrame:
    """Pairs ``(a, b)`` with a < b of points (id, x, y, h) within both bounds, the bounds included."""
    cell = lambda c, e: F.floor(F.col(c) / e)
    at = points.select("id", "x", "y", "h", cell("x", eps_km).alias("cx"), cell("y", eps_km).alias("cy"), cell("h", eps_hours).alias("ch"))
    met = beside(at, ["cx", "cy", "ch"], ["id", "x", "y", "h"]).where(~F.col("own") | (F.col("id") < F.col("id2")))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    close = met.where((dx * dx + dy * dy <= eps_km * eps_km) & (F.abs(F.col("h") - F.col("h2")) <= eps_hours))
    return close.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def beside(rows: DataFrame, cell: list[str], fields: list[str]) -> DataFrame:
    """Rows of equal and of neighbouring cells side by side, the second's fields with a 2 behind their names; ``own`` where the cells are equal.

    Of two neighbouring cells one looks into the other: 13 of 26 directions, and the own cell, where both orders and a row with itself are among the pairs.
    """
    ahead = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in ahead))).alias("s")
    moved = [(F.col(c) + F.col(f"s.{d}")).alias(c) for c, d in zip(cell, "ijk", strict=True)]
    own = ((F.col("s.i") == 0) & (F.col("s.j") == 0) & (F.col("s.k") == 0)).alias("own")
    looks = rows.select("*", steps).select(*moved, own, *(F.col(c).alias(f"{c}2") for c in fields))
    return rows.select(*cell, *fields).join(looks.hint("merge"), cell)


def st_dbscan(points: DataFrame, eps_km: float = dims.EPS_KM, eps_hours: float = dims.EPS_HOURS, min_samples: int = dims.MIN_SAMPLES) -> DataFrame:
    """``(id, cluster)``: the smallest core id of the cluster, or -1 for noise, which is kept.

    A point is core with at least ``min_samples`` points in reach, itself counted. A point in reach of several
    clusters without being core joins the one of the smallest label.
    """
    if min_samples <= 2 and eps_km > 0 and eps_hours > 0:
        return st_dbscan_pairs(points, eps_km, eps_hours, min_samples)
    if eps_km > 0 and eps_hours > 0:
        return st_dbscan_dense(points, eps_km, eps_hours, min_samples)
    pairs = neighbours(project(points), eps_km, eps_hours)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg((F.count("*") + 1).alias("reach"))
    cores = (points.select("id") if min_samples <= 1 else degree.where(F.col("reach") >= min_samples).select(F.col("a").alias("id")))
    if min_samples <= 2:  # whoever has a neighbour is core: no border
        links = pairs
    else:
        ids = cores.select(F.col("id").alias("a"))
        links = pairs.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    reached = components(links).withColumnRenamed("node", "id")
    labels = cores.join(reached, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    if min_samples > 2:
        named = labels.withColumnRenamed("id", "b")
        border = both.join(named, "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
        labels = labels.unionByName(border.join(cores, "id", "left_anti").select("id", "cluster"))
    return points.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


#: Comparisons of points that settle two cells at once; with more points the cells are cut finer first. Cuts of a side, and how often.
FEW_PAIRS, CUTS, MOST_CUTS = 4096, 4, 8
PART = ["rep", "fx", "fy", "fh"]
#: Small cells on a side of a tile, whose links are settled in one group: at most 8,192 cells, each with its neighbours two cells around.
TILE = {"x": 32, "y": 32, "h": 8}
SIDES = [f"{end}_{c}" for c in "xyh" for end in ("low", "high")]


def cell_sides(eps_km: float, eps_hours: float) -> dict[str, float]:
    """Sides of cells so small that all points of one are within both bounds of one another."""
    return {"x": eps_km / math.sqrt(2) * (1 - 1e-9), "y": eps_km / math.sqrt(2) * (1 - 1e-9), "h": eps_hours * (1 - 1e-9)}


def boxes(points: DataFrame, cell: list[str]) -> DataFrame:
    """Cells with their smallest id, number of points and bounding box; they combine before the shuffle."""
    ends = [agg(c).alias(f"{name}_{c}") for c in "xyh" for name, agg in (("low", F.min), ("high", F.max))]
    return points.groupBy(*cell).agg(F.min("id").alias("least"), F.count("*").alias("n"), *ends)


def judged(pairs: DataFrame, eps_km: float, eps_hours: float) -> DataFrame:
    """Pairs of boxes within reach, with ``linked``: whether all points of one are within the bounds of all of the other, else only some may be."""
    gap = {c: F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"high_{c}2"), F.col(f"low_{c}2") - F.col(f"high_{c}")) for c in "xyh"}
    span = {c: F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}2"), F.col(f"high_{c}2") - F.col(f"low_{c}")) for c in "xyh"}
    within = lambda d: (d["x"] * d["x"] + d["y"] * d["y"] <= eps_km * eps_km) & (d["h"] <= eps_hours)
    return pairs.where(within(gap)).withColumn("linked", within(span)).select(*PART, *(f"{c}2" for c in PART), "n", "n2", "linked")


def second(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"{c}2" for c in df.columns))


def cell_links(placed: DataFrame, open_: DataFrame, eps_km: float, eps_hours: float) -> DataFrame:
    """Links ``(a, b)`` between the groups ``rep`` and ``rep2`` of cells that have points within the bounds of each other, for pairs of cells that boxes leave open.

    Points are compared where that is little work; elsewhere both cells are cut finer and their parts settled by boxes again, down to a last cut of
    some centimetres and seconds. One link of two groups is enough: their other pairs are asked no more in the next cut.
    """
    side = cell_sides(eps_km, eps_hours)
    asked = open_.select(*PART).unionByName(open_.select(*(F.col(f"{c}2").alias(c) for c in PART))).distinct()
    points = Stored(placed.join(asked.hint("merge"), ["fx", "fy", "fh"]).select(*PART, "id", "x", "y", "h"), "points").df
    found = open_.where("linked").select("rep", "rep2")
    for cut in range(1, MOST_CUTS + 2):
        left = open_.where("NOT linked").join(found, ["rep", "rep2"], "left_anti")
        few = (F.col("n") * F.col("n2") <= FEW_PAIRS) | F.lit(cut > MOST_CUTS)
        here = points.select(*PART, "x", "y", "h").hint("merge")
        both = left.where(few).select(*PART, *(f"{c}2" for c in PART)).join(here, PART).join(second(here), [f"{c}2" for c in PART])
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        close = both.where((dx * dx + dy * dy <= eps_km * eps_km) & (F.abs(F.col("h") - F.col("h2")) <= eps_hours))
        found = Stored(found.unionByName(close.select("rep", "rep2")).distinct(), "found").df
        many = Stored(left.where(~few).join(found, ["rep", "rep2"], "left_anti"), "many").df
        if many.isEmpty():
            break
        # Only the points of parts that are still asked for go on; the finer grid lies within the coarser one.
        asked = many.select(*PART).unionByName(many.select(*(F.col(f"{c}2").alias(c) for c in PART))).distinct()
        above = {f"p{c}": F.col(f"f{c}") for c in "xyh"}
        finer = {f"f{c}": F.floor(F.col(c) / (side[c] / CUTS**cut)) for c in "xyh"}
        points = Stored(points.join(asked, PART, "left_semi").withColumns(above).withColumns(finer), "points").df
        parts = boxes(points, [*PART, "px", "py", "ph"]).drop("least")
        whole = [F.col("rep"), *(F.col(f"f{c}").alias(f"p{c}") for c in "xyh")]
        over = many.select(*whole, F.col("rep2"), *(F.col(f"f{c}2").alias(f"p{c}2") for c in "xyh"))
        cut_up = over.join(parts.hint("merge"), ["rep", "px", "py", "ph"]).join(second(parts).hint("merge"), ["rep2", "px2", "py2", "ph2"])
        open_ = Stored(judged(cut_up, eps_km, eps_hours), "pairs").df
        found = found.unionByName(open_.where("linked").select("rep", "rep2").distinct())
    return found.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))


def st_dbscan_pairs(points: DataFrame, eps_km: float, eps_hours: float, min_samples: int) -> DataFrame:
    """``st_dbscan`` where one neighbour makes a core: the components of small cells that have points within the bounds of each other."""
    return placed_clusters(project(points), eps_km, eps_hours, min_samples)


def placed_clusters(at: DataFrame, eps_km: float = dims.EPS_KM, eps_hours: float = dims.EPS_HOURS, min_samples: int = 2) -> DataFrame:
    """``(id, cluster)`` of points (id, x, y, h) that have been projected."""
    side = cell_sides(eps_km, eps_hours)
    grid = ["fx", "fy", "fh"]
    placed = Stored(at.select("id", "x", "y", "h").withColumns({f"f{c}": F.floor(F.col(c) / side[c]) for c in "xyh"}), "placed").df
    cells = Stored(boxes(placed, grid).withColumnRenamed("least", "rep"), "cells").df
    # Cells within reach of each other are at most two apart, so pairs of them are neighbours. Boxes settle most pairs: too far, or linked whatever the points.
    pairs = cells.withColumns({f"c{c}": F.floor(F.col(f"f{c}") / 2) for c in "xyh"})
    met = beside(pairs, ["cx", "cy", "ch"], [*PART, "n", *SIDES]).where(~F.col("own") | (F.col("rep") < F.col("rep2")))
    near = Stored(judged(met, eps_km, eps_hours), "pairs").df
    tile = {f"t{c}": F.floor(F.col(f"f{c}") / TILE[c]) for c in "xyh"}
    linked = near.where("linked").select(F.col("rep").alias("a"), F.col("rep2").alias("b"), *(c.alias(k) for k, c in tile.items()))
    grouped = tiled_components(linked, list(tile), at_once=FEW_LINKS).withColumnRenamed("node", "rep")
    core = F.col("component").isNotNull() | (F.col("n") > 1) | F.lit(min_samples <= 1)
    named = Stored(cells.join(grouped.hint("merge"), "rep", "left").select("rep", *grid, F.coalesce("component", "rep").alias("label"), core.alias("core")), "named").df
    # What the sure links have joined is asked no more: points are compared only where that can tie two groups of cells.
    told = named.select("rep", "label").hint("merge")  # what grows with the input goes by shuffles, not over the driver
    apart = near.where("NOT linked").join(told, "rep").join(second(told), "rep2").where("label <> label2")
    asked = Stored(apart.drop("rep", "rep2").withColumnsRenamed({"label": "rep", "label2": "rep2"}), "apart").df
    joined = components(cell_links(placed, asked, eps_km, eps_hours), at_once=FEW_LINKS).withColumnRenamed("node", "label")
    label = F.coalesce("component", F.when(F.col("core"), F.col("label")), F.lit(-1).cast("long"))
    labelled = Stored(named.join(joined.hint("merge"), "label", "left").select(*grid, label.alias("cluster")), "labels").df
    return placed.join(labelled.hint("merge"), grid).select("id", "cluster")


def st_dbscan_dense(points: DataFrame, eps_km: float, eps_hours: float, min_samples: int) -> DataFrame:
    """``st_dbscan`` where more than one neighbour makes a core, without a list of all pairs.

    All points of a small cell are within the bounds of one another: a cell of ``min_samples`` points holds cores only. Only points of thinner
    cells, of which a place has few, are counted; a cell that lies in reach as a whole counts by its number. Clusters are those of the cores
    by small cells; what is no core asks the cells around it for their cluster, point by point where only some of a cell's points may be in reach.
    """
    side = cell_sides(eps_km, eps_hours)
    grid = ["fx", "fy", "fh"]
    at = project(points).select("id", "x", "y", "h").where("x IS NOT NULL AND y IS NOT NULL AND h IS NOT NULL")
    placed = Stored(at.withColumns({f"f{c}": F.floor(F.col(c) / side[c]) for c in "xyh"}), "placed").df
    cells = Stored(boxes(placed, grid).withColumnRenamed("least", "rep"), "cells").df
    named = Stored(placed.join(cells.select(*grid, "rep", "n").hint("merge"), grid), "named").df
    thin = named.where(F.col("n") < min_samples)
    pairs = cells.withColumns({f"c{c}": F.floor(F.col(f"f{c}") / 2) for c in "xyh"})
    met = beside(pairs, ["cx", "cy", "ch"], [*PART, "n", *SIDES]).where(~F.col("own") | (F.col("rep") < F.col("rep2")))
    one = judged(met, eps_km, eps_hours).select("rep", "n", "rep2", "n2", "linked")
    two = one.select(F.col("rep2").alias("rep"), F.col("n2").alias("n"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), "linked")
    around = Stored(one.unionByName(two).where(F.col("n") < min_samples), "around").df
    some = around.where("NOT linked").select("rep", "rep2")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    close = (dx * dx + dy * dy <= eps_km * eps_km) & (F.abs(F.col("h") - F.col("h2")) <= eps_hours)
    sure = around.where("linked").groupBy("rep").agg(F.sum("n2").alias("sure"))
    here = named.select(F.col("rep").alias("rep2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("h").alias("h2"))
    counted = some.join(thin.select("rep", "id", "x", "y", "h"), "rep").join(here, "rep2").where(close).groupBy("id").agg(F.count("*").alias("found"))
    total = F.col("n") + F.coalesce("sure", F.lit(0)) + F.coalesce("found", F.lit(0))
    judged_thin = Stored(thin.join(sure, "rep", "left").join(counted, "id", "left").select("id", "rep", "x", "y", "h", (total >= min_samples).alias("core")), "thin").df
    cores = named.where(F.col("n") >= min_samples).select("id", "rep", "x", "y", "h").unionByName(judged_thin.where("core").drop("core"))
    labels = Stored(placed_clusters(cores.select("id", "x", "y", "h"), eps_km, eps_hours, 1), "cores").df
    told = Stored(cores.join(labels, "id").select(F.col("rep").alias("rep2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("h").alias("h2"), "cluster"), "told").df
    # The cores of one cell are in one cluster.
    of_cell = told.groupBy("rep2").agg(F.min("cluster").alias("cluster"))
    others = judged_thin.where("NOT core").drop("core")
    whole = around.where("linked").select("rep", "rep2").unionByName(cells.select("rep", F.col("rep").alias("rep2")))
    by_cell = whole.join(of_cell, "rep2").groupBy("rep").agg(F.min("cluster").alias("cluster"))
    by_point = some.join(others, "rep").join(told, "rep2").where(close).select("id", "cluster")
    border = others.join(by_cell, "rep").select("id", "cluster").unionByName(by_point).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return points.select("id").join(labels.unionByName(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def members(points: DataFrame, **bounds) -> DataFrame:
    """``points`` with their ``cluster``."""
    return points.join(st_dbscan(points, **bounds).hint("merge"), "id")


def cell_area(clustered: DataFrame) -> DataFrame:
    """``(cluster, area_ha)``: sensor cells that were hit, each counted once with the size its first detection gives."""
    size = F.expr("greatest(coalesce(nullif(scan_km, 0e0), 0.375e0), 0.375e0)")
    dlat = size / dims.KM_PER_DEGREE
    dlon = size / (dims.KM_PER_DEGREE * F.cos(F.radians("latitude")))
    keyed = clustered.select("cluster", "us", "id", size.alias("size"), (F.col("latitude") / dlat).cast("long").alias("ci"), (F.col("longitude") / dlon).cast("long").alias("cj"))
    first = keyed.groupBy("cluster", "ci", "cj").agg(F.min_by("size", F.struct("us", "id")).alias("size"))
    return first.groupBy("cluster").agg(F.expr(f.rnd("sum(size * size) * 100e0", 1)).alias("area_ha"))


def incidents(clustered: DataFrame, now: float) -> DataFrame:
    """One row per cluster, noise left out: times, counts, heat, weighted centre, area, growth, status and severity."""
    found = clustered.where("cluster >= 0")
    weight = F.greatest(F.coalesce("frp_mw", F.lit(0.0)), F.lit(0.1))
    sums = found.groupBy("cluster").agg(
        F.count("*").alias("detection_count"), F.min("hours").alias("first_h"), F.max("hours").alias("last_h"), F.min("us").alias("first_us"),
        F.expr(f.rnd("coalesce(sum(frp_mw), 0e0)", 1)).alias("total_frp"), F.expr(f.rnd("coalesce(max(frp_mw), 0e0)", 1)).alias("max_frp"),
        F.sum(weight * F.col("latitude")).alias("wlat"), F.sum(weight * F.col("longitude")).alias("wlon"), F.sum(weight).alias("w"),
        F.min_by(F.struct("latitude", "longitude", "us"), F.struct("us", "id")).alias("anchor"),
    )
    joined = sums.join(cell_area(found), "cluster")
    growth = f.rnd("area_ha / greatest(last_h - first_h, 1e0)", 2)
    scored = joined.withColumns({
        "latitude": F.expr(f.rnd("wlat / w", 6)), "longitude": F.expr(f.rnd("wlon / w", 6)),
        "growth": F.expr(growth), "status": F.expr(f.status(f"({f.num(now)} - last_h)")),
    }).withColumn("score", F.expr(f.rnd(f.severity_score("area_ha", "total_frp", "growth"), 2)))
    ranked = scored.withColumn("severity", F.expr(f.severity("score")))
    return ranked.withColumn("incident_id", incident_id()).drop("wlat", "wlon", "w")


def incident_id():
    """A stable name of a cluster: digest of place and time of its first detection, the time in ISO format with offset and, where there are any, microseconds."""
    utc = F.to_utc_timestamp(F.timestamp_micros(F.col("anchor.us")), F.current_timezone())
    part = F.pmod("anchor.us", F.lit(1_000_000))
    time = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != 0, F.format_string(".%06d", part)).otherwise(""), F.lit("+00:00"))
    place = F.concat_ws(":", F.format_string("%.3f", "anchor.latitude"), F.format_string("%.3f", "anchor.longitude"), time)
    return F.left(F.sha1(place), F.lit(16))


def picture_order(found: DataFrame) -> DataFrame:
    """Ranked by severity, then area; the smallest cluster label breaks ties."""
    return found.orderBy(F.expr(f.severity_rank("severity")).desc(), F.col("area_ha").desc(), F.col("cluster"))


def signals(clustered: DataFrame) -> DataFrame:
    """Per cluster what plausibility is judged by, each rounded before it is used."""
    found = clustered.where("cluster >= 0")
    spread = f"sqrt(power((max(latitude) - min(latitude)) * {f.num(dims.KM_PER_DEGREE)}, 2) + power((max(longitude) - min(longitude)) * {f.num(dims.KM_PER_DEGREE)} * cos(radians(avg(latitude))), 2))"
    return found.groupBy("cluster").agg(
        F.count("*").alias("n"), F.expr(f.rnd("max(coalesce(frp_mw, 0e0))", 2)).alias("peak_frp"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce(frp_mw, 0e0) DESC)").alias("median_frp"),
        F.expr(f.rnd("coalesce(sum(CASE WHEN NOT is_daytime THEN 1e0 ELSE 0e0 END) / nullif(count(is_daytime), 0), 0e0)", 2)).alias("night_fraction"),
        F.count_distinct("day").alias("days"), F.expr(f.rnd("max(hours) - min(hours)", 1)).alias("span_h"),
        F.expr(f.rnd(spread, 2)).alias("spread_km"), F.count_distinct("satellite").alias("satellites"),
    )


PLAUSIBILITY = f"""least(1e0, greatest(0e0, 0.5e0
  + CASE WHEN peak_frp >= 25 THEN 0.3e0 WHEN peak_frp >= 5 THEN 0.1e0 WHEN peak_frp < 2 THEN -0.22e0 ELSE 0e0 END
  + CASE WHEN n >= 3 AND night_fraction >= 0.99e0 THEN -0.18e0 WHEN night_fraction <= 0.5e0 THEN 0.1e0 ELSE 0e0 END
  + CASE WHEN days >= 3 AND spread_km < 1 THEN -0.28e0 WHEN spread_km >= 2 THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN cover_code IS NULL OR cover_code = '' THEN 0e0 WHEN burnable THEN 0.08e0 ELSE -0.3e0 END
  + CASE WHEN satellites >= 2 AND n >= 6 THEN 0.05e0 ELSE 0e0 END))"""
# Thresholds are met with a margin far below the steps of the score, so that sums of the same terms agree everywhere.
VERDICT = "CASE WHEN raw >= 0.65e0 - 1e-9 THEN 'wildfire' WHEN raw >= 0.45e0 - 1e-9 THEN 'probable' WHEN raw >= 0.25e0 - 1e-9 THEN 'questionable' ELSE 'likely_not_wildfire' END"


def assess(found: DataFrame) -> DataFrame:
    """Adds score, verdict and ``is_suspect`` to signals with ``cover_code`` and ``burnable``."""
    judged = found.withColumn("raw", F.expr(PLAUSIBILITY)).withColumn("verdict", F.expr(VERDICT))
    return judged.withColumn("plausibility", F.expr(f.rnd("raw", 3))).withColumn("is_suspect", F.col("verdict").isin("questionable", "likely_not_wildfire")).drop("raw")
