"""Containment in an outline of any number of edges, by an index of grid cells.

Cells that no edge comes near are inside or outside as a whole. Only points of the other cells, those on the border, are held
against edges, and only against those of their row of cells. The outline comes from GeoJSON; where there is none, or it cannot be
read, all points count as inside, as a missing file must not empty the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.storage import Stored, broadcast_if_small

#: Degrees of a cell's side.
CELL = 0.1
EDGES = "x1 double, y1 double, x2 double, y2 double"
RING = "array<array<array<double>>>"


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of all rings, holes too, of a GeoJSON feature, geometry or collection of features; none where the file is missing or holds no polygon."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(store):
        return spark.createDataFrame([], EDGES)
    text = spark.read.text(path, wholetext=True)
    kind = "type string, coordinates string"
    shapes = F.from_json("value", f"{kind}, geometry struct<{kind}>, features array<struct<geometry: struct<{kind}>>>").alias("j")
    each = text.select(shapes).select(F.explode(F.concat(F.array(F.struct("j.type", "j.coordinates"), F.col("j.geometry")), F.coalesce(F.col("j.features.geometry"), F.array().cast(f"array<struct<{kind}>>")))).alias("g"))
    many = F.when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{RING}>")).when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", RING)))
    rings = each.select(F.explode(many).alias("polygon")).select(F.explode("polygon").alias("ring"))
    pairs = rings.select(F.posexplode("ring").alias("k", "a"), "ring").select("a", F.get("ring", (F.col("k") + 1) % F.size("ring")).alias("b"))
    edges = pairs.select(F.get("a", 0).alias("x1"), F.get("a", 1).alias("y1"), F.get("b", 0).alias("x2"), F.get("b", 1).alias("y2"))
    return edges.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")


def lines(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


class AreaIndex:
    """Cells of an outline and the edges of each row of cells, stored once; ``margin_km`` widens what counts as inside."""

    def __init__(self, edges: DataFrame, margin_km: float = 0.0, cell: float = CELL) -> None:
        self.cell, self.margin = cell, margin_km / dims.KM_PER_DEGREE
        reach = self.margin + 1e-9
        kept = Stored(edges.select("x1", "y1", "x2", "y2"), "edges").df
        self.empty = kept.isEmpty()
        if self.empty:
            return
        row = lines(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, cell).alias("row")
        self.rows = Stored(kept.select(row, F.struct("x1", "y1", "x2", "y2").alias("e")).groupBy("row").agg(F.collect_list("e").alias("edges")), "rows").df
        # An edge is near the cells around its pieces, each no longer than a cell.
        n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / cell))
        at = lambda c, k: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * k / F.col("n")
        pieces = kept.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        ends = pieces.select(*(at(c, F.col("k") + i).alias(f"{c}{'ab'[i]}") for c in "xy" for i in (0, 1)))
        tall = ends.withColumn("row", lines(F.least("ya", "yb") - reach, F.greatest("ya", "yb") + reach, cell))
        border = tall.select("row", lines(F.least("xa", "xb") - reach, F.greatest("xa", "xb") + reach, cell).alias("col")).distinct()
        # Runs of cells of a row between border cells lie on one side: inside where a ray to the east from one of them crosses an odd number of edges.
        middle = (F.col("row") + 0.5) * cell
        crossed = kept.select(lines(F.least("y1", "y2"), F.greatest("y1", "y2"), cell).alias("row"), "x1", "y1", "x2", "y2").where((F.col("y1") > middle) != (F.col("y2") > middle))
        crossings = crossed.select("row", F.floor(((F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")) / cell).alias("col"))
        at_row = crossings.groupBy("row").agg(F.collect_list("col").alias("cols"))
        edge = border.groupBy("row").agg(F.collect_set("col").alias("border"))
        cells = edge.join(at_row, "row", "left").select("row", "border", F.explode(F.sequence(F.array_min("border"), F.array_max("border"))).alias("col"), F.coalesce("cols", F.array().cast("array<bigint>")).alias("cols"))
        odd = F.size(F.filter("cols", lambda c: c > F.col("col"))) % 2 == 1
        state = F.when(F.array_contains("border", F.col("col")), F.lit("border")).when(odd, F.lit("inside"))
        self.cells = Stored(cells.select("row", "col", state.alias("state")).where("state IS NOT NULL"), "cells").df

    def mark(self, points: DataFrame) -> DataFrame:
        """``points`` (latitude, longitude) with ``inside``."""
        if self.empty:
            return points.withColumn("inside", F.lit(True))
        x, y = F.col("longitude"), F.col("latitude")
        celled = points.withColumn("row", F.floor(y / self.cell)).withColumn("col", F.floor(x / self.cell))
        known = celled.join(broadcast_if_small(self.cells), ["row", "col"], "left")
        edges = self.rows.select(F.col("row").alias("edge_row"), "edges")
        held = known.join(broadcast_if_small(edges), (F.col("state") == "border") & (F.col("row") == F.col("edge_row")), "left")
        crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

        def near(e):
            dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
            t = F.least(F.greatest(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
            return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2)) <= self.margin

        odd = F.aggregate("edges", F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
        on_border = odd | F.exists("edges", near) if self.margin else odd
        inside = F.when(F.col("state") == "border", F.coalesce(on_border, F.lit(False))).otherwise(F.coalesce(F.col("state") == "inside", F.lit(False)))
        return held.withColumn("inside", inside).drop("row", "col", "state", "edge_row", "edges")
