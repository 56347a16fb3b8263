"""Convex hulls of groups of points, merged from partial hulls, and their buffers.

A task keeps the hull of what it has seen of each group, not the points, so a group of any number of points, over any number of
tasks, comes down to a few corners before the shuffle. Coordinates are taken as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlake.shipping import ship

#: Corners that a task holds before it hands its partial hulls on.
MOST_CORNERS = 200_000
#: Largest turn between two corners of a buffer's round parts.
ARC_STEP = math.pi / 32
Point = tuple[float, float]


def turn(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_of(points: list[Point]) -> list[Point]:
    """Corners of the hull counterclockwise from the leftmost, lowest one; one or two points where all are alike or in line."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered
    halves = []
    for way in (ordered, ordered[::-1]):
        half: list[Point] = []
        for p in way:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def buffered(corners: list[Point], radius: float) -> list[Point]:
    """The corners of everything within ``radius`` of a hull, counterclockwise: sides moved out, and arcs round its corners."""
    n = len(corners)
    if n == 1:
        steps = math.ceil(2 * math.pi / ARC_STEP)
        return [(corners[0][0] + radius * math.cos(2 * math.pi * k / steps), corners[0][1] + radius * math.sin(2 * math.pi * k / steps)) for k in range(steps)]
    out = []
    for k, (x, y) in enumerate(corners):
        (px, py), (qx, qy) = corners[k - 1], corners[(k + 1) % n]
        # Outward is to the right of a side: from that of the side that ends here to that of the one that begins.
        begin = math.atan2(-(x - px), y - py)
        sweep = (math.atan2(-(qx - x), qy - y) - begin) % (2 * math.pi)
        steps = max(1, math.ceil(sweep / ARC_STEP))
        out += [(x + radius * math.cos(begin + sweep * i / steps), y + radius * math.sin(begin + sweep * i / steps)) for i in range(steps + 1)]
    return out


def ring_area(ring: list[Point]) -> float:
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def ring_length(ring: list[Point]) -> float:
    return sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def convex_hulls(points: DataFrame, key: str, x: str = "longitude", y: str = "latitude", radius: float = 0.0) -> DataFrame:
    """``key, n, hull_area, hull_length, corners, ring``: of each group with a position its hull's measures and, ``radius`` further out, a ring of (x, y).

    Points without a coordinate count in ``n`` only; a null key is a group.
    """
    ship(points.sparkSession)
    field = points.schema[key]
    partial = T.StructType([field, *T.StructType.fromDDL("n long, xs array<double>, ys array<double>").fields])
    flat = points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    def rows(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        corners = [h for _, h in held.values()]
        arrays = [pa.array(held, kind), pa.array([n for n, _ in held.values()], pa.int64())]
        return pa.record_batch([*arrays, *(pa.array([[p[i] for p in h] for h in corners], pa.list_(pa.float64())) for i in (0, 1))], names=[key, "n", "xs", "ys"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            fresh: dict = {}
            for k, px, py in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh.setdefault(k, []).append((px, py))
            for k, found in fresh.items():
                n, corners = held.get(k, (0, []))
                held[k] = n + len(found), hull_of(corners + [p for p in found if None not in p])
            if sum(len(h) for _, h in held.values()) > MOST_CORNERS:
                yield rows(held, kind)
                held = {}
        if held:
            yield rows(held, kind)

    done = T.StructType([field, *T.StructType.fromDDL("n long, hull_area double, hull_length double, corners long, ring array<struct<x: double, y: double>>").fields])

    def merge(group: pa.Table) -> pa.Table:
        corners = hull_of([p for xs, ys in zip(group.column("xs").to_pylist(), group.column("ys").to_pylist(), strict=True) for p in zip(xs, ys, strict=True)])
        if not corners:
            return pa.table({f.name: [] for f in done}).cast(pa.schema([group.schema.field(0), *RESULT]))
        ring = buffered(corners, radius) if radius else corners
        values = [[sum(group.column("n").to_pylist())], [ring_area(corners)], [ring_length(corners)], [len(corners)], [[{"x": a, "y": b} for a, b in ring]]]
        return pa.table([group.column(0).slice(0, 1), *(pa.array(v, f.type) for v, f in zip(values, RESULT, strict=True))], names=[f.name for f in done])

    return flat.mapInArrow(gather, partial).groupBy(key).applyInArrow(merge, done)


RESULT = [pa.field("n", pa.int64()), pa.field("hull_area", pa.float64()), pa.field("hull_length", pa.float64()), pa.field("corners", pa.int64()), pa.field("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]
