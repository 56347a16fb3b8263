"""Imagery as a long table of pixels: indices, burn severity, patches, rings of unburnt vegetation, choice of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import regions

# Scale and offset of digital numbers, and the least share of usable pixels.
SCALE, OFFSET = 0.0001, -0.1
LEAST_USABLE = 0.40
PIXEL_M, PIXEL_HA = 20.0, 0.04
LEAST_PATCH_HA = 0.5


def reflectance(band: str) -> str:
    return f"({band} * {f.num(SCALE)} + {f.num(OFFSET)})"


def usable(scl: str = "scl") -> Column:
    return ~F.col(scl).isin(*dims.INVALID_SCENE_CLASSES) & (F.expr(reflectance("b8a")) > 0)


def indices(pixels: DataFrame) -> DataFrame:
    """Adds nbr, ndmi, ndvi (null where the pixel cannot be used), ``valid`` and ``water``."""
    pair = lambda a, b: F.expr(f.normalised_difference(reflectance(a), reflectance(b)))
    marked = pixels.withColumn("valid", usable()).withColumn("water", F.col("scl") == dims.WATER_CLASS)
    return marked.withColumns({n: F.when(F.col("valid"), pair("b8a", b)) for n, b in (("nbr", "b12"), ("ndmi", "b11"), ("ndvi", "b04"))})


def to_coarse(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """Red at 10 m to 20 m: the mean of each block."""
    return pixels.groupBy("site", "scene", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.expr(f.rnd("avg(b04)", 3)).alias("b04"))


def burn_difference(stack: DataFrame) -> DataFrame:
    """Pixels of both scenes side by side, by one aggregation instead of a self-join: pre, dnbr, class."""
    side = lambda s, c: F.max(F.when(F.col("scene") == s, F.col(c)))
    both = stack.groupBy("site", "row", "col").agg(
        side("pre", "nbr").alias("pre"), side("post", "nbr").alias("post"), F.bool_and("valid").alias("valid"), F.bool_or("water").alias("water"), F.count("*").alias("scenes"),
    )
    return both.where("scenes = 2").withColumn("dnbr", F.when(F.col("valid"), F.col("pre") - F.col("post"))).drop("scenes").withColumn("severity", F.expr(f"CASE WHEN dnbr IS NOT NULL THEN {f.burn_class('dnbr')} END"))


def patches(difference: DataFrame, least_dnbr: float = 0.10) -> DataFrame:
    """Burnt pixels with the id of their patch of 4-connected pixels: the number of its first pixel.

    Pixels are numbered by the height and width of the largest raster.
    """
    height, width = difference.agg(F.coalesce(F.max("row") + 1, F.lit(1)), F.coalesce(F.max("col") + 1, F.lit(1))).first()
    number = lambda row, col: (F.col("site") * height + row) * width + col
    burnt = difference.where((F.col("dnbr") >= least_dnbr) & ~F.col("water")).withColumn("pixel", number(F.col("row"), F.col("col")))
    found = regions.label(burnt.select("site", "row", "col"), ["site"]).withColumnRenamed("region", "first")
    patch = number(F.shiftright("first", 32), F.col("first").bitwiseAND(regions.ROW_STEP - 1))
    return burnt.join(found.select("site", "row", "col", patch.alias("patch")), ["site", "row", "col"])


def patch_polygons(patched: DataFrame) -> DataFrame:
    """``(site, patch, cells, holes, corners, rings)``: the outline of each patch, holes included, in pixels (x east, y south)."""
    keys = ["site"]
    return regions.polygons(regions.rings(patched.select("site", "row", "col", F.col("patch").alias("region")), keys), keys).withColumnRenamed("region", "patch")


def to_metres(rings: str, pixel_m: float = PIXEL_M) -> Column:
    """Rings of pixel corners in map units from the raster's upper left corner, x east and y north."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct((p["x"] * pixel_m).alias("x"), (-p["y"] * pixel_m).alias("y"))))


def near_seed(patched: DataFrame, reach_m: float, seed_row: int = 12, seed_col: int = 12, pixel_m: float = 20.0) -> DataFrame:
    """Patches of at least half a hectare with a pixel within ``reach_m`` of the fire's seed."""
    gap = F.sqrt(F.pow((F.col("row") - seed_row) * pixel_m, 2) + F.pow((F.col("col") - seed_col) * pixel_m, 2))
    kept = patched.groupBy("patch").agg((F.count("*") * PIXEL_HA).alias("ha"), F.min(gap).alias("gap")).where((F.col("ha") >= LEAST_PATCH_HA) & (F.col("gap") <= reach_m))
    return patched.join(kept.select("patch"), "patch", "left_semi")


def severity_areas(patched: DataFrame) -> DataFrame:
    """Burnt hectares of each site and class; classes without a pixel do not appear."""
    return patched.groupBy("site", "severity").agg(F.expr(f.rnd(f"count(*) * {f.num(PIXEL_HA)}", 2)).alias("ha"))


def scar(difference: DataFrame, patched: DataFrame) -> DataFrame:
    """Per site: burnt area, mean dNBR and RdNBR of the patches, dominant class, share of usable pixels and its verdict."""
    total = difference.groupBy("site").agg(F.expr(f.rnd("avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END)", 3)).alias("usable"))
    burnt = patched.groupBy("site").agg(
        F.expr(f.rnd(f"count(*) * {f.num(PIXEL_HA)}", 2)).alias("burned_ha"), F.expr(f.rnd("avg(dnbr)", 4)).alias("mean_dnbr"), F.expr(f.rnd(f"avg({f.relative_dnbr('dnbr', 'pre')})", 4)).alias("mean_rdnbr"),
    )
    top = severity_areas(patched).groupBy("site").agg(F.max_by("severity", F.struct("ha", "severity")).alias("dominant"))
    joined = total.join(burnt, "site", "left").join(top, "site", "left")
    return joined.withColumn("outcome", F.expr(f"CASE WHEN usable < {f.num(LEAST_USABLE)} THEN 'too cloudy' WHEN burned_ha IS NULL THEN 'no scar' ELSE 'measured' END"))


def ring_medians(stack: DataFrame, inner_m: float, outer_m: float, least: int, seed_row: int = 12, seed_col: int = 12, pixel_m: float = 20.0) -> DataFrame:
    """Exact interpolated medians of moisture and greenness in a ring around the seed; none below ``least`` pixels."""
    gap = F.sqrt(F.pow((F.col("row") - seed_row) * pixel_m, 2) + F.pow((F.col("col") - seed_col) * pixel_m, 2))
    ring = stack.where((F.col("scene") == "pre") & F.col("valid") & ~F.col("water") & (gap > inner_m) & (gap <= outer_m))
    return ring.groupBy("site").agg(F.count("*").alias("n"), F.expr(f.rnd("percentile(ndmi, 0.5)", 4)).alias("ndmi"), F.expr(f.rnd("percentile(ndvi, 0.5)", 4)).alias("ndvi")).where(F.col("n") >= least)


def best_scene(scenes: DataFrame, cloud_limit: float = dims.CLOUD_LIMIT_PCT) -> DataFrame:
    """Per site the usable scene: those that cover the area come first, if any does; then ten-point steps of cloud, then newest."""
    fit = scenes.where(F.col("cloud_pct") <= cloud_limit)
    order = F.struct((~F.col("covers")).cast("int").alias("c"), F.floor(F.col("cloud_pct") / 10).alias("step"), (-F.col("observed_h")).alias("age"), F.col("scene_id").alias("id"))
    return fit.groupBy("site").agg(F.min_by(F.struct("scene_id", "cloud_pct", "covers"), order).alias("s")).select("site", "s.*")


def windows_of(first_h: Column, last_h: Column, now: float) -> tuple[Column, Column, Column, Column]:
    """Search windows in hours: 45 days up to half a day before the fire, and half a day after it up to 30 days or now."""
    return first_h - 12 - 45 * 24, first_h - 12, first_h + 12, F.least(last_h + 30 * 24, F.lit(now))
