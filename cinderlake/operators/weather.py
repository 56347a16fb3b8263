"""Hourly weather to daily inputs, and the fire weather index as a fold over the days of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import formulas as f


def daily_inputs(hourly: DataFrame) -> DataFrame:
    """Per site and day the reading nearest 10 UTC, the earlier on a tie, with the day's rain; days without it go.

    One aggregation: the nearest reading is a minimum over a struct, so hours combine before the shuffle.
    """
    near = F.struct(F.abs(F.col("hour_of_day") - 10).alias("off"), F.col("hour").alias("hour"))
    fields = F.struct("temperature_c", "humidity_pct", F.coalesce("wind_kmh", F.lit(0.0)).alias("wind_kmh"), "month", "latitude")
    days = hourly.groupBy("site", "day").agg(F.min_by(fields, near).alias("noon"), F.sum("rain_mm").alias("day_rain"))
    flat = days.select("site", "day", "noon.*", "day_rain")
    return flat.where("temperature_c IS NOT NULL AND humidity_pct IS NOT NULL")


def day_struct():
    d = f.SPARK
    fields = {
        "t": "temperature_c", "rh": "humidity_pct", "w": "wind_kmh", "rain": "day_rain",
        "dl": f.day_factor(d, f.DMC_DAY_46, f.DMC_DAY_20, "month", "latitude"), "cl": f.day_factor(d, f.DC_DAY_46, f.DC_DAY_20, "month", "latitude"),
    }
    return F.expr(d.struct(**fields, **{k: "0e0" for k in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")}))


def fire_weather(daily: DataFrame) -> DataFrame:
    """Codes and indices of each site after its last day. Codes are carried from day to day as rounded.

    The fold runs over a site's days in one array: a season of days, some kilobytes, whatever the number of sites.
    """
    series = daily.select("site", "day", day_struct().alias("d")).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("day", "d"))).alias("s"))
    last = series.select("site", F.size("s").cast("long").alias("n_days"), F.col("s.d").alias("days")).withColumn("last", F.expr(f.fwi_fold(f.SPARK, "days")))
    return last.select(
        "site", "n_days", "last.ffmc", "last.dmc", "last.dc", *(F.expr(f.rnd(f"last.{c}", 2)).alias(c) for c in ("isi", "bui", "fwi")), F.expr(f.danger_class("last.fwi")).alias("danger_class")
    )


def reading_now(hourly: DataFrame, now: float) -> DataFrame:
    """Per site the reading closest to ``now`` (hours), the earlier on a tie."""
    near = F.struct(F.abs(F.col("hour") - F.lit(now)).alias("off"), F.col("hour").alias("hour"))
    return hourly.groupBy("site").agg(F.min_by(F.struct(F.coalesce("wind_kmh", F.lit(0.0)).alias("wind_kmh"), "wind_from_deg"), near).alias("r")).select("site", "r.*")
