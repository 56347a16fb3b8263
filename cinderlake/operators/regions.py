"""Connected regions of raster cells, and their outlines as polygons with holes.

A raster is a long table of cells: some key columns (the raster's name), ``row`` and ``col``. It is cut into square tiles. A tile
is one group of bounded size, labelled and traced by itself; what crosses a tile's border is put together afterwards, by
components over labels (not cells) and by joining the ends of traced chains. A raster that fits a tile needs no such round.

Each cell brings four directed sides, its inside on the left. Sides that two cells share cancel; the rest are walked into
rings. A ring that touches itself in a corner is cut there, so that every ring is simple: outer rings run counterclockwise in
the plane of (col, row), holes clockwise.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlake.operators.graph import FEW_LINKS, components
from cinderlake.shipping import ship
from cinderlake.storage import Stored, broadcast_if_small

#: Rows and columns of a tile: at most 65,536 cells meet in a task.
TILE = 256
#: A cell's number within its raster: row and column in one value, ordered by row, then column.
ROW_STEP = 1 << 32
Point = tuple[int, int]


def code(row: str = "row", col: str = "col") -> Column:
    return F.col(row).cast("long") * ROW_STEP + F.col(col).cast("long")


def schema_of(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(more).fields)


def tiles(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))


def label_cells(places: Iterable[Point]) -> dict[Point, Point]:
    """By cell (row, col): the first cell, by row, then column, that is reached over shared sides."""
    over: dict[Point, Point] = {}

    def top(p: Point) -> Point:
        while (up := over[p]) != p:
            over[p] = p = over[up]
        return p

    for p in sorted(set(places)):
        over[p] = p
        for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1)):
            if q in over:
                a, b = top(p), top(q)
                over[max(a, b)] = min(a, b)
    return {p: top(p) for p in over}


def label(cells: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """``keys, row, col, region``: cells, each once, with the number (``code``) of the first cell of their 4-connected region."""
    ship(cells.sparkSession)
    schema = schema_of(cells, keys, "row long, col long, piece long, low long")
    pieces = [0]  # counts within a task, which unpickles it anew

    def run(group: pa.Table) -> pa.Table:
        low = label_cells(zip(group.column("row").to_pylist(), group.column("col").to_pylist(), strict=True))
        task = TaskContext.get().partitionId() << 33
        number: dict[Point, int] = {}
        for first in low.values():
            if first not in number:
                number[first] = task + pieces[0]
                pieces[0] += 1
        names = [group.column(k).take(pa.array([0] * len(low))) for k in keys]
        rest = [[p[0] for p in low], [p[1] for p in low], [number[f] for f in low.values()], [f[0] * ROW_STEP + f[1] for f in low.values()]]
        return pa.table(names + [pa.array(x, pa.int64()) for x in rest], names=[*keys, "row", "col", "piece", "low"])

    plain = cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    local = Stored(tiles(plain, tile).groupBy(*keys, "tile_row", "tile_col").applyInArrow(run, schema), "regions").df
    # Only cells on both sides of a tile's border can tie pieces of different tiles.
    raster = F.struct(*keys).alias("raster")  # in a struct null keys are equal
    down = local.where(F.pmod("row", F.lit(tile)) == tile - 1).select(raster, F.col("piece").alias("a"), (F.col("row") + 1).alias("row"), "col")
    right = local.where(F.pmod("col", F.lit(tile)) == tile - 1).select(raster, F.col("piece").alias("a"), "row", (F.col("col") + 1).alias("col"))
    edge = local.where((F.pmod("row", F.lit(tile)) == 0) | (F.pmod("col", F.lit(tile)) == 0)).select(raster, "row", "col", F.col("piece").alias("b"))
    ties = Stored(down.unionByName(right).join(edge, ["raster", "row", "col"]).select("a", "b").distinct(), "ties")
    if ties.df.isEmpty():
        ties.drop()
        return local.select(*keys, "row", "col", F.col("low").alias("region"))
    whole = components(ties.df, at_once=FEW_LINKS).withColumnRenamed("node", "piece")
    lows = local.select("piece", "low").distinct().join(whole, "piece")
    region = lows.groupBy("component").agg(F.min("low").alias("region"))
    told = broadcast_if_small(Stored(whole.join(region, "component").select("piece", "region"), "whole").df)
    return local.join(told, "piece", "left").select(*keys, "row", "col", F.coalesce("region", "low").alias("region"))


def trace_cells(own: dict[Point, int], beside: set[Point]) -> list[tuple[int, bool, list[Point]]]:
    """(region, closed, corners (col, row)) of the chains of uncancelled sides of ``own`` cells; ``beside`` are cells of other tiles."""
    sides: list[tuple[Point, Point, Point]] = []
    leaving: dict[Point, list[int]] = {}
    there = lambda p: p in own or p in beside
    for r, c in own:
        corners = ((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1))
        for k, neighbour in enumerate(((r - 1, c), (r, c + 1), (r + 1, c), (r, c - 1))):
            if not there(neighbour):
                leaving.setdefault(corners[k], []).append(len(sides))
                sides.append((corners[k], corners[(k + 1) % 4], (r, c)))
    after = [-1] * len(sides)
    led = [False] * len(sides)
    for i, (_, end, cell) in enumerate(sides):
        ways = leaving.get(end, ())
        # Where two cells meet in a corner alone, two sides leave it: the way goes on round the same cell.
        same = [j for j in ways if sides[j][2] == cell]
        if same or len(ways) == 1:
            after[i] = (same or ways)[0]
            led[after[i]] = True
    out = []
    done = [False] * len(sides)
    for begin in [*(i for i, x in enumerate(led) if not x), *range(len(sides))]:
        if done[begin]:
            continue
        i, corners_of = begin, [sides[begin][0]]
        while True:
            done[i] = True
            corners_of.append(sides[i][1])
            i = after[i]
            if i < 0 or done[i]:
                break
        closed = i == begin
        out.append((own[sides[begin][2]], closed, corners_of[:-1] if closed else corners_of))
    return out


def simple_rings(corners: list[Point]) -> list[list[Point]]:
    """A closed way cut where it meets itself, each ring without corners in straight runs, begun at its least corner."""
    rings, way, at = [], [], {}
    for p in corners:
        if p in at:
            start = at[p]
            rings.append(way[start:])
            for q in way[start + 1 :]:
                del at[q]
            del way[start + 1 :]
        else:
            at[p] = len(way)
            way.append(p)
    rings.append(way)
    out = []
    for ring in rings:
        bent = [q for p, q, r in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if (p[0] == q[0]) != (q[0] == r[0])]
        if bent:
            k = bent.index(min(bent))
            out.append(bent[k:] + bent[:k])
    return out


def signed_area(ring: list[Point]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) // 2


def trace_raster(cells: list[Point]) -> list[tuple[int, int, list[int], list[int]]]:
    """(region, area, xs, ys) of the rings of a whole raster that fits a tile, as ``label`` and ``rings`` give them."""
    low = label_cells(cells)
    ringed = {(r, c) for r, c in low if (r - 1, c) in low and (r + 1, c) in low and (r, c - 1) in low and (r, c + 1) in low}  # have no side of their own
    found = []
    for region, _, corners in trace_cells({p: f[0] * ROW_STEP + f[1] for p, f in low.items() if p not in ringed}, ringed):
        found += [(region, signed_area(ring), [p[0] for p in ring], [p[1] for p in ring]) for ring in simple_rings(corners)]
    return found


def in_order(chains: list[tuple[Point, Point, list[Point]]]) -> list[list[Point]]:
    """Closed ways made of chains (start, end, corners), each going on where another begins."""
    by_start = {c[0]: c for c in chains}
    ways = []
    while by_start:
        begin = min(by_start)
        at, way = begin, []
        while at in by_start:
            _, end, corners = by_start.pop(at)
            way += corners[:-1]
            at = end
        ways.append(way)
    return ways


RING = "region long, area long, xs array<int>, ys array<int>"


def rings(labelled: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """``keys, region, area, xs, ys``: the simple rings of each region by their corners; ``area`` in cells, negative for holes."""
    ship(labelled.sparkSession)
    steps = {"row": (-1, 1), "col": (-1, 1)}
    placed = tiles(labelled.select(*keys, "row", "col", "region"), tile).withColumn("own", F.lit(True))
    parts = [placed]
    for name, ways in steps.items():
        for way in ways:  # a cell on a tile's border is told to the tile beyond
            at = F.pmod(F.col(name), F.lit(tile)) == (0 if way < 0 else tile - 1)
            parts.append(placed.where(at).withColumn("own", F.lit(False)).withColumn(f"tile_{name}", F.col(f"tile_{name}") + way))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    numbers = [0]

    def run(group: pa.Table) -> pa.Table:
        own, beside = {}, set()
        for r, c, region, mine in zip(*(group.column(x).to_pylist() for x in ("row", "col", "region", "own")), strict=True):
            if mine:
                own[r, c] = region
            else:
                beside.add((r, c))
        out = []
        task = TaskContext.get().partitionId() << 33
        for region, closed, corners in trace_cells(own, beside):
            for ring in simple_rings(corners) if closed else [corners]:
                numbers[0] += 1
                out.append((task + numbers[0], region, closed, signed_area(ring) if closed else None, [p[0] for p in ring], [p[1] for p in ring]))
        names = [group.column(k).take(pa.array([0] * len(out), pa.int64())) for k in keys]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table(names + [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=[*keys, "chain", "region", "closed", "area", "xs", "ys"])

    chains = Stored(every.groupBy(*keys, "tile_row", "tile_col").applyInArrow(run, schema_of(labelled, keys, "chain long, region long, closed boolean, area long, xs array<int>, ys array<int>")), "chains").df
    whole, open_ = chains.where("closed").select(*keys, *(c.split()[0] for c in RING.split(", "))), chains.where("NOT closed")
    if open_.isEmpty():
        return whole
    # A way leaves a tile where just one chain of another tile goes on.
    raster = F.struct(*keys).alias("raster")
    ends = open_.select(raster, F.col("chain").alias("a"), F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"))
    starts = open_.select(raster, F.col("chain").alias("b"), F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"))
    way = components(ends.join(starts, ["raster", "x", "y"]).select("a", "b"), at_once=FEW_LINKS).withColumnRenamed("node", "chain")

    def close(group: pa.Table) -> pa.Table:
        chained = [[*zip(xs, ys, strict=True)] for xs, ys in zip(group.column("xs").to_pylist(), group.column("ys").to_pylist(), strict=True)]
        region = group.column("region")[0].as_py()
        found = [r for w in in_order([(c[0], c[-1], c) for c in chained]) for r in simple_rings(w)]
        names = [group.column(k).take(pa.array([0] * len(found), pa.int64())) for k in keys]
        rest = [pa.array([region] * len(found), pa.int64()), pa.array([signed_area(r) for r in found], pa.int64())]
        rest += [pa.array([[p[i] for p in r] for r in found], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.table(names + rest, names=[*keys, "region", "area", "xs", "ys"])

    return whole.unionByName(open_.join(way, "chain").groupBy("component").applyInArrow(close, schema_of(labelled, keys, RING)))


def polygons(traced: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, region, cells, holes, corners, rings``: one polygon per region, its outer ring first, then its holes by their first corner.

    ``rings`` holds (x, y) corners in cells, not repeated at the end; ``cells`` is the area by the rings alone.
    """
    ring = F.struct((F.col("area") < 0).alias("hole"), F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).alias("corners"))
    gathered = traced.groupBy(*keys, "region").agg(F.sum("area").alias("cells"), F.count_if(F.col("area") < 0).alias("holes"), F.sum(F.size("xs")).cast("long").alias("corners"), F.sort_array(F.collect_list(ring)).alias("r"))
    return gathered.select(*keys, "region", "cells", "holes", "corners", F.col("r.corners").alias("rings"))


def perimeter(rings_column: str) -> Column:
    """Sides along all rings of a polygon, in cells."""
    along = lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c)), F.lit(0).cast("long"),
        lambda total, i: total + F.abs(F.get(c, i % F.size(c))["x"] - F.get(c, i - 1)["x"]) + F.abs(F.get(c, i % F.size(c))["y"] - F.get(c, i - 1)["y"]),
    )
    return F.aggregate(rings_column, F.lit(0).cast("long"), lambda total, c: total + along(c))


def multipolygon(parts: str) -> Column:
    """GeoJSON geometry of an array of polygons, each an array of rings of (lon, lat) structs, closed here."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, lambda polygon: F.transform(polygon, ring)).alias("coordinates"))
