"""Ground heights around incidents and the plane through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import formulas as f

SPACING_M = 400.0


def sample_grid(places: DataFrame) -> DataFrame:
    """A 5 x 5 grid around each place: ``i`` steps to the east, ``j`` to the north."""
    steps = F.sequence(F.lit(-2), F.lit(2))
    return places.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))


def heights(incidents: DataFrame) -> DataFrame:
    """The height that the adapter gives each sample."""
    c, i, j = F.col("cluster"), F.col("i"), F.col("j")
    z = (c % 500) + i * SPACING_M * ((c % 31) - 15) / 100.0 + j * SPACING_M * ((c % 23) - 11) / 100.0 + ((c * 7 + i * 3 + j * 5) % 9)
    return sample_grid(incidents.select("cluster")).withColumn("z", z)


def plane_fit(samples: DataFrame) -> DataFrame:
    """Slope, aspect (the way uphill), relief and centre height; the grid's axes are orthogonal, so two slopes give the plane."""
    fit = samples.groupBy("cluster").agg(
        F.regr_slope("z", F.col("i") * SPACING_M).alias("dzdx"), F.regr_slope("z", F.col("j") * SPACING_M).alias("dzdy"),
        (F.max("z") - F.min("z")).alias("relief"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("z"))).alias("centre"),
    )
    aspect = f.positive_mod("degrees(atan2(dzdx, dzdy))", 360)
    return fit.select("cluster", F.expr(f.rnd("100e0 * sqrt(dzdx * dzdx + dzdy * dzdy)", 1)).alias("slope_pct"), F.expr(f.rnd(aspect, 1)).alias("aspect_deg"), F.expr(f.rnd("relief", 1)).alias("relief_m"), F.expr(f.rnd("centre", 1)).alias("centre_m"))
