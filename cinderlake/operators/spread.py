"""Spread, exposure and the ensemble of scenarios, as column expressions over incidents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import regions
from cinderlake.shipping import ship

#: Rows and columns of the grid on which footprints are united and intersected.
GRID_STEPS = 40
#: What an ellipse on it is given by.
SHAPE = ("sin", "cos", "shift", "long", "wide")
#: Grids whose rings are held at a time.
ROWS_AT_ONCE = 256


def estimate(df: DataFrame) -> DataFrame:
    """Adds the spread estimate to rows with isi, wind_from, wind, slope, aspect (null: none), a, b, c and moist.

    Wind and slope push add as vectors. Rates are rounded here, and everything further uses the rounded values.
    """
    toward = f.positive_mod("wind_from + 180e0", 360)
    push = f"CASE WHEN aspect IS NULL OR slope <= 0 THEN 0e0 ELSE {f.slope_wind_kmh('slope')} END"
    step = df.withColumn("_toward", F.expr(toward)).withColumn("_push", F.expr(push))
    step = step.withColumn("_e", F.expr("wind * sin(radians(_toward)) + _push * sin(radians(coalesce(aspect, 0e0)))"))
    step = step.withColumn("_n", F.expr("wind * cos(radians(_toward)) + _push * cos(radians(coalesce(aspect, 0e0)))"))
    step = step.withColumn("_still", F.expr("_push = 0 OR sqrt(_e * _e + _n * _n) < 1e-6"))
    step = step.withColumn("effective_wind", F.expr("CASE WHEN _push = 0 THEN wind WHEN _still THEN 0e0 ELSE sqrt(_e * _e + _n * _n) END"))
    step = step.withColumn("_dir", F.expr(f"CASE WHEN _still THEN _toward ELSE {f.positive_mod('degrees(atan2(_e, _n)) + 360e0', 360)} END"))
    step = step.withColumn("_isi", F.expr("greatest(isi, 0e0) * exp(0.05039e0 * (effective_wind - wind))"))
    step = step.withColumn("_head", F.expr("a * power(1e0 - exp(-b * _isi), c) * moist"))
    step = step.withColumn("_lb", F.expr(f.length_to_breadth("effective_wind")))
    step = step.withColumn("_back", F.expr(f"_head * (1e0 - {f.eccentricity('_lb')}) / (1e0 + {f.eccentricity('_lb')})"))
    out = step.withColumns({
        "head_ros": F.expr(f.rnd("_head", 1)), "back_ros": F.expr(f.rnd("_back", 1)), "flank_ros": F.expr(f.rnd("(_head + _back) / (2e0 * _lb)", 1)),
        "lb": F.expr(f.rnd("_lb", 2)), "direction": F.expr(f.rnd("_dir", 1)), "confidence": F.expr("CASE WHEN effective_wind > 40 OR _isi > 30 THEN 'low' ELSE 'moderate' END"),
        "heading": F.expr(f.compass_point("_dir")), "effective_isi": F.col("_isi"),
    })
    return out.drop("_toward", "_push", "_e", "_n", "_still", "_dir", "_isi", "_head", "_lb", "_back")


def with_fuel(df: DataFrame, fuels: DataFrame, key: str) -> DataFrame:
    """Adds a, b, c of the fuel in ``key``; an unknown or missing fuel burns as the default one."""
    coefficients = F.broadcast(fuels.select(F.col("fuel").alias("fuel_used"), "a", "b", "c"))
    known = F.coalesce(*(F.when(F.col(key) == k, F.lit(k)) for k, *_ in dims.FUELS), F.lit(dims.DEFAULT_FUEL))
    return df.withColumn("fuel_used", known).join(coefficients, "fuel_used")


def exposure(near: DataFrame) -> DataFrame:
    """Places near incidents, with direction (of spread), head_ros and lb: arrival, downwind flag and threat score."""
    turned = near.withColumn("off", F.expr(f.angle_between("bearing", "direction")))
    reached = turned.withColumn("rate", F.expr(f.rate_toward("head_ros", "lb", "off")))
    timed = reached.withColumn("_m", F.expr(f.minutes_to_reach("rate", "km"))).withColumn("minutes", F.expr(f"CASE WHEN _m <= {f.num(dims.MAX_LEAD_MIN)} THEN _m END")).drop("_m")
    flagged = timed.withColumn("downwind", F.expr(f"abs(off) <= {f.num(dims.DOWNWIND_HALF_ANGLE)}"))
    return flagged.withColumn("threat", F.expr(f.threat_score("kind", f.rnd("km", 2), "minutes", "downwind", "population")))


def scenario_spread(incidents: DataFrame, scenarios: DataFrame, fuels: DataFrame, moisture: DataFrame) -> DataFrame:
    """Every incident under every scenario (a dimension of nine rows), with its own wind, fuel, slope and moisture.

    ``incidents`` has ffmc, day_isi, wind_kmh, wind_from_deg, slope_pct, aspect_deg, fuel (null: unknown) and ndmi.
    """
    both = incidents.crossJoin(F.broadcast(scenarios))
    winds = both.withColumns({
        "wind": F.expr("wind_kmh * wind_factor"), "wind_from": F.expr(f.positive_mod("wind_from_deg + wind_offset", 360)),
        "slope": F.expr("slope_pct * slope_factor"), "aspect": F.col("aspect_deg"), "chosen": F.coalesce("scenario_fuel", "fuel"),
    })
    winds = winds.withColumn("isi", F.expr(f"CASE WHEN ffmc IS NOT NULL THEN {f.isi('ffmc', 'wind')} ELSE day_isi END"))
    fuelled = with_fuel(winds.drop("fuel"), fuels, "chosen")
    ranges = F.broadcast(moisture.withColumnRenamed("fuel", "fuel_used"))
    wet = fuelled.join(ranges, "fuel_used").withColumn("lfm", F.expr(f"CASE WHEN ndmi IS NOT NULL THEN {f.live_moisture('ndmi', 'ndmi_dry', 'ndmi_wet', 'lfmc_dry', 'lfmc_wet')} * moisture_factor END"))
    return estimate(wet.withColumn("moist", F.expr(f"CASE WHEN lfm IS NULL THEN 1e0 ELSE {f.spread_factor('lfm', 'lfmc_dry', 'lfmc_wet', 'reference')} END")))


def footprints(spread: DataFrame, minutes: tuple[int, ...] = dims.HORIZONS_MIN) -> DataFrame:
    """Each scenario at each horizon, with the area of its footprint."""
    each = spread.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    return each.withColumn("area_ha", F.expr(f.footprint_area_ha("head_ros", "back_ros", "lb", "direction", "minutes", "latitude")))


def agreement_rows(prints: DataFrame, steps: int = GRID_STEPS) -> DataFrame:
    """``(cluster, minutes, cell, shapes)``: the ellipses of all scenarios of a horizon in one row, with the side of a grid cell in km.

    The grid of ``steps`` x ``steps`` cells around each fire spans twice the longest run of the horizon, rows running north and columns
    east, so its size is fixed and its resolution follows the fire. A row is small and its work is not: rows are dealt out to a number of
    tasks of its own, as the bytes of a shuffle would have all of them in a few.
    """
    length = (F.col("head_ros") + F.col("back_ros")) * F.col("minutes") / 1000.0
    turn = F.radians("direction")
    shape = F.struct(
        F.sin(turn).alias("sin"), F.cos(turn).alias("cos"), (length / 2 - F.col("back_ros") * F.col("minutes") / 1000.0).alias("shift"),
        F.nullif(length / 2, F.lit(0.0)).alias("long"), F.nullif(length / F.greatest("lb", F.lit(1.0)) / 2, F.lit(0.0)).alias("wide"),
    )
    grouped = prints.groupBy("cluster", "minutes").agg(F.collect_list(shape).alias("shapes"), F.max(F.col("head_ros") * F.col("minutes") / 1000.0).alias("reach"))
    spark = prints.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return grouped.select("cluster", "minutes", (F.greatest(F.col("reach"), F.lit(0.01)) * 2.0 / steps).alias("cell"), "shapes").repartition(tasks, F.xxhash64("cluster", "minutes"))


def hits(cell: float, shapes: dict[str, np.ndarray], steps: int) -> np.ndarray:
    """How many of the ellipses cover the middle of each cell (row, column); one without length covers nothing."""
    middle = (np.arange(steps) + 0.5) * cell - cell * steps / 2
    sin, cos, shift, long, wide = (shapes[k][:, None, None] for k in SHAPE)
    e, n = middle[None, None, :], middle[None, :, None]
    u = (e * sin + n * cos - shift) / long
    v = (e * cos - n * sin) / wide
    return (u * u + v * v <= 1).sum(axis=0)


def grids(batch: pa.RecordBatch, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``agreement_rows`` the cells that some scenario covers, and those that all cover."""
    at = np.concatenate([[0], np.cumsum(batch.column("shapes").value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    flat = batch.column("shapes").flatten()
    fields = {k: flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in SHAPE}  # null: NaN, which is within nothing
    for i, cell in enumerate(batch.column("cell").to_numpy(zero_copy_only=False)):
        n = hits(cell, {k: x[at[i] : at[i + 1]] for k, x in fields.items()}, steps)
        yield n > 0, n == at[i + 1] - at[i]


def agreement(prints: DataFrame, steps: int = GRID_STEPS) -> DataFrame:
    """Per incident and horizon the area that any scenario covers (envelope) and that all do (core), on a grid."""
    ship(prints.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for batch in batches:
                cells = np.array([(some.sum(), every.sum()) for some, every in grids(batch, steps)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "minutes", "cell")), pa.array(cells[:, 0]), pa.array(cells[:, 1])], names=["cluster", "minutes", "cell", "n_any", "n_all"])

    rows = agreement_rows(prints, steps)
    counted = rows.mapInArrow(count, regions.schema_of(rows, ["cluster", "minutes", "cell"], "n_any long, n_all long"))
    return counted.select("cluster", "minutes", F.col("n_any").alias("envelope_cells"), F.col("n_all").alias("core_cells"), (F.col("n_any") * F.col("cell") * F.col("cell") * 100).alias("envelope_ha"), (F.col("n_all") * F.col("cell") * F.col("cell") * 100).alias("core_ha"))


def agreement_rings(prints: DataFrame, kinds: tuple[str, ...] = ("envelope", "core"), steps: int = GRID_STEPS) -> DataFrame:
    """``(cluster, minutes, cell, kind, region, area, xs, ys)``: the rings around what some scenario covers and around what all do.

    A grid is no larger than a tile of ``regions``, so a row's rings are traced where its cells are found: no cell travels.
    """
    if steps > regions.TILE:
        raise ValueError(f"a grid of {steps} steps is larger than a tile of {regions.TILE}")
    ship(prints.sparkSession)
    rows = agreement_rows(prints, steps)
    schema = regions.schema_of(rows, ["cluster", "minutes", "cell"], f"kind string, {regions.RING}")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(start, ROWS_AT_ONCE)
                    found = []
                    for i, grid in enumerate(grids(batch, steps)):
                        for kind, cells in zip(("envelope", "core"), grid, strict=True):
                            if kind in kinds:
                                found += [(i, kind, *ring) for ring in regions.trace_raster([*zip(*(x.tolist() for x in np.nonzero(cells)), strict=True)])]
                    kept = pa.array([x[0] for x in found], pa.int64())
                    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    columns = [*(batch.column(c).take(kept) for c in ("cluster", "minutes", "cell")), *(pa.array([x[k + 1] for x in found], t) for k, t in enumerate(types))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(trace, schema)


def agreement_outlines(prints: DataFrame, kinds: tuple[str, ...] = ("envelope", "core"), steps: int = GRID_STEPS) -> DataFrame:
    """``(cluster, minutes, kind, cell, region, cells, holes, corners, rings)``: the union of all scenarios (envelope) and what they agree on (core), a polygon for each connected part."""
    return regions.polygons(agreement_rings(prints, kinds, steps), ["cluster", "minutes", "kind", "cell"])


def grid_to_map(rings: str, steps: int = GRID_STEPS):
    """Rings of grid corners as rings of (lon, lat) around latitude and longitude of the row."""
    def corner(p):
        east, north = (p["x"] - steps / 2) * F.col("cell"), (p["y"] - steps / 2) * F.col("cell")
        return F.struct((F.col("longitude") + east / (dims.KM_PER_DEGREE * F.cos(F.radians("latitude")))).alias("lon"), (F.col("latitude") + north / dims.KM_PER_DEGREE).alias("lat"))

    return F.transform(rings, lambda ring: F.transform(ring, corner))


def threats(spread: DataFrame, near: DataFrame, most_minutes: int = max(dims.HORIZONS_MIN)) -> DataFrame:
    """Per incident and place: how many scenarios arrive in time, the first and the upper median arrival, likelihood."""
    total = spread.groupBy("cluster").agg(F.count("*").alias("scenario_count"))
    arrive = spread.select("cluster", "scenario_no", "scenario", "head_ros", "lb", "direction").join(near.select("cluster", "place_no", "name", "km", "bearing"), "cluster")
    rate = arrive.withColumn("off", F.expr(f.angle_between("bearing", "direction"))).withColumn("rate", F.expr(f.rate_toward("head_ros", "lb", "off")))
    hits = rate.withColumn("m", F.expr(f.minutes_to_reach("rate", "km"))).where(F.col("m") <= most_minutes)
    ordered = hits.groupBy("cluster", "place_no", "name").agg(F.sort_array(F.collect_list(F.struct("m", "scenario_no", "scenario"))).alias("h"))
    joined = ordered.join(total, "cluster")
    return joined.select(
        "cluster", "place_no", "name", F.size("h").cast("long").alias("hit_count"), "scenario_count", F.col("h.m")[0].alias("earliest"),
        F.expr("h.m[CAST(floor(size(h) / 2) AS INT)]").alias("median"), F.array_join("h.scenario", ",").alias("scenarios_hit"), F.expr(f.rnd("size(h) / (scenario_count * 1e0)", 3)).alias("likelihood"),
    )
