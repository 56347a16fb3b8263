"""Queries on weather, places, spread and the ensemble, each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators import areas, geo, regions, spread, terrain, weather
from cinderlake.plans.oracles import AROUND, OUTLINE, values
from cinderlake.plans.picture import clustered, incidents, land_cover_of
from cinderlake.plans.registry import Registry
from cinderlake.sources import adapters

query = Registry()


# Area of interest.


@query("bbox_filter", "SELECT id, latitude, longitude FROM alldet WHERE latitude BETWEEN 37 AND 39 AND longitude BETWEEN 22 AND 25")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.all_detections(spark, sf_dir).where("latitude BETWEEN 37 AND 39 AND longitude BETWEEN 22 AND 25").select("id", "latitude", "longitude")


CROSSINGS = "SELECT det.id, count(*) FILTER ((y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2 = 1 AS odd, min(sqrt(power(longitude - x1 - t * (x2 - x1), 2) + power(latitude - y1 - t * (y2 - y1), 2))) AS apart FROM (SELECT det.*, side.*, least(greatest(((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0e0), 1e0) AS t FROM det, side) det GROUP BY det.id"


@query("boundary_pip", f"SELECT id FROM ({CROSSINGS}) WHERE odd")
def boundary_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.within_boundary(adapters.detections(spark, sf_dir), dims.boundary_edges(spark)).where("inside").select("id")


@query("boundary_index", f"SELECT id FROM ({CROSSINGS.replace('FROM det, side', 'FROM alldet AS det, side')}) WHERE odd OR apart <= 5e0 / 111.32e0")
def boundary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections in the outline or near it, by grid cells: only those of border cells are held against edges."""
    index = areas.AreaIndex(dims.boundary_edges(spark), dims.BOUNDARY_MARGIN_KM)
    return index.mark(adapters.all_detections(spark, sf_dir)).where("inside").select("id")


@query("boundary_margin", f"SELECT count(*) AS total, count(*) FILTER (odd OR apart <= 5e0 / 111.32e0) AS kept, count(*) FILTER (NOT (odd OR apart <= 5e0 / 111.32e0)) AS dropped FROM ({CROSSINGS})")
def boundary_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = geo.within_boundary(adapters.detections(spark, sf_dir), dims.boundary_edges(spark), dims.BOUNDARY_MARGIN_KM)
    return judged.agg(F.count("*").alias("total"), F.count_if("inside").alias("kept"), F.count_if(~F.col("inside")).alias("dropped"))


# Places.


@query("nearest_place", f"SELECT cluster, name AS place, {f.rnd('km', 3)} AS place_km FROM inc LEFT JOIN (SELECT cluster, name, km FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY km, place_no) AS k FROM near WHERE km <= 25 AND kind IN ('settlement', 'natura2000')) WHERE k = 1) USING (cluster)")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_place(incidents(spark, sf_dir), dims.places(spark)).select("cluster", "place", F.expr(f.rnd("place_km", 3)).alias("place_km"))


@query("incident_name", "SELECT cluster, concat(coalesce(name, concat('Unnamed ', printf('%.2f', floor(latitude * 1e2 + 0.5e0 + 1e-7) / 1e2), 'N ', printf('%.2f', floor(longitude * 1e2 + 0.5e0 + 1e-7) / 1e2), 'E')), ' · ', strftime(make_timestamp(first_us), '%d %b')) AS name FROM inc LEFT JOIN (SELECT cluster, name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY km, place_no) AS k FROM near WHERE km <= 25 AND kind IN ('settlement', 'natura2000')) WHERE k = 1) USING (cluster)")
def incident_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents(spark, sf_dir)
    named = found.join(geo.nearest_place(found, dims.places(spark)), "cluster")
    unnamed = F.concat(F.lit("Unnamed "), F.format_string("%.2f", F.expr(f.rnd("latitude", 2))), F.lit("N "), F.format_string("%.2f", F.expr(f.rnd("longitude", 2))), F.lit("E"))
    return named.select("cluster", F.concat(F.coalesce("place", unnamed), F.lit(" · "), F.date_format(F.timestamp_micros("first_us"), "dd MMM")).alias("name"))


@query("places_within", f"SELECT cluster, name, {f.rnd('km', 3)} AS km, {f.rnd('bearing', 2)} AS bearing, {f.compass_point('bearing')} AS compass FROM near WHERE km <= 30")
def places_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = geo.places_within(incidents(spark, sf_dir), dims.places(spark), dims.EXPOSURE_RADIUS_KM)
    return near.select("cluster", "name", F.expr(f.rnd("km", 3)).alias("km"), F.expr(f.rnd("bearing", 2)).alias("bearing"), F.expr(f.compass_point("bearing")).alias("compass"))


@query("text_search", "SELECT DISTINCT cluster, name FROM near WHERE km <= 25 AND contains(lower(name), 'park')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = geo.places_within(incidents(spark, sf_dir), dims.places(spark), dims.NEAREST_PLACE_KM)
    return near.where(F.lower("name").contains("park")).select("cluster", "name").distinct()


# Weather.


@query("weather_unzip", "SELECT site, hour, temperature_c, humidity_pct, wind_kmh, rain_mm, hour > (SELECT now FROM nowh) AS is_forecast FROM wx")
def weather_unzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings arrive as parallel arrays per site; ragged arrays give nulls."""
    columns = ("hour", "temperature_c", "humidity_pct", "wind_kmh", "rain_mm")
    rows = adapters.hourly_weather(spark, sf_dir)
    packed = rows.groupBy("site").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("r")).select("site", *(F.col(f"r.{c}").alias(c) for c in columns))
    return weather_rows(packed, adapters.now_hours(spark, sf_dir))


def weather_rows(packed: DataFrame, now: float) -> DataFrame:
    """Rows of a table whose columns are parallel arrays."""
    names = [c for c in packed.columns if c not in ("site", "hour")]
    each = packed.select("site", *names, F.posexplode("hour").alias("i", "hour"))
    return each.select("site", "hour", *(F.get(c, F.col("i")).alias(c) for c in names), (F.col("hour") > F.lit(now)).alias("is_forecast"))


@query("daily_inputs", "SELECT site, day, temperature_c, humidity_pct, coalesce(wind_kmh, 0e0) AS wind_kmh, day_rain, month FROM noon")
def daily_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.daily_inputs(adapters.hourly_weather(spark, sf_dir)).drop("latitude")


@query("fwi_series", "SELECT site, n_days, ffmc, dmc, dc, isi, bui, fwi, danger_class FROM danger")
def fwi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.fire_weather(weather.daily_inputs(adapters.hourly_weather(spark, sf_dir)))


@query("danger_class_hist", "SELECT danger_class, count(*) AS sites FROM danger GROUP BY danger_class")
def danger_class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fwi_series(spark, sf_dir).groupBy("danger_class").agg(F.count("*").alias("sites"))


GRID = "(SELECT i, j, floor((347e0 + i * 2.5e0) * 100 + 0.5e0) / 1000e0 AS latitude, floor((193e0 + j * 2.5e0) * 100 + 0.5e0) / 1000e0 AS longitude FROM (SELECT unnest(range(0, 29)) AS i), (SELECT unnest(range(0, 42)) AS j))"


@query("danger_grid", f"SELECT latitude, longitude, fwi, danger_class FROM {GRID} g JOIN danger ON site = (i * 42 + j) % 100")
def danger_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The danger of each point of a quarter-degree grid over the area; points are counted in whole steps."""
    points = grid_points(spark, 0.25)
    return points.join(fwi_series(spark, sf_dir), (F.col("i") * 42 + F.col("j")) % 100 == F.col("site")).select("latitude", "longitude", "fwi", "danger_class")


def grid_points(spark: SparkSession, step: float) -> DataFrame:
    rows = int((dims.AOI_NORTH - dims.AOI_SOUTH) / step + 1e-9) + 1
    columns = int((dims.AOI_EAST - dims.AOI_WEST) / step + 1e-9) + 1
    n = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
    at = lambda low, k: F.floor((low * 10 + F.col(k) * (step * 10)) * 100 + 0.5) / 1000.0
    return n.select("i", "j", at(dims.AOI_SOUTH, "i").alias("latitude"), at(dims.AOI_WEST, "j").alias("longitude"))


@query("fwi_reference_day", "SELECT " + ", ".join(f"{f.rnd(f'x.{c}', 2)} AS {c}" for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")) + " FROM (SELECT " + f.fwi_fold(f.DUCK, "[" + f.DUCK.struct(t="17e0", rh="42e0", w="25e0", rain="0e0", dl="12.8e0", cl="0.9e0", ffmc="0e0", dmc="0e0", dc="0e0", isi="0e0", bui="0e0", fwi="0e0") + "]") + " AS x)")
def fwi_reference_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published example: 17 °C, 42 %, 25 km/h, no rain, April."""
    day = spark.sql("SELECT 1L AS site, 1L AS day, 17e0 AS temperature_c, 42e0 AS humidity_pct, 25e0 AS wind_kmh, 0e0 AS day_rain, 4 AS month, 46e0 AS latitude")
    return weather.fire_weather(day).select("ffmc", "dmc", "dc", "isi", "bui", "fwi")


# Spread.

WHAT_IF = [(float(i), float(w), float(s), fuel) for fuel, *_ in dims.FUELS for i in (0, 5, 15, 40) for w in (0, 10, 35, 60) for s in (0, 12, 52)]


@query("spread_whatif")
def spread_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calculator: a grid of inputs, aspect down the wind where there is a slope."""
    inputs = dims.frame(spark, WHAT_IF, "isi double, wind double, slope double, fuel string").withColumn("wind_from", F.lit(30.0)).withColumn("moist", F.lit(1.0))
    fuelled = spread.with_fuel(inputs.withColumn("aspect", F.expr("CASE WHEN slope > 0 THEN 250e0 END")), dims.fuels(spark), "fuel")
    return spread.estimate(fuelled).select("isi", "wind", "slope", "fuel", "head_ros", "flank_ros", "back_ros", "lb", "direction", "heading", "confidence")


def spread_sql(rows: str) -> str:
    """The estimate in DuckDB, step by step, over rows with its inputs."""
    toward = f.positive_mod("wind_from + 180e0", 360)
    s1 = f"SELECT *, {toward} AS tw, CASE WHEN aspect IS NULL OR slope <= 0 THEN 0e0 ELSE {f.slope_wind_kmh('slope')} END AS push FROM ({rows})"
    s2 = f"SELECT *, wind * sin(radians(tw)) + push * sin(radians(coalesce(aspect, 0e0))) AS ve, wind * cos(radians(tw)) + push * cos(radians(coalesce(aspect, 0e0))) AS vn FROM ({s1})"
    s3 = f"SELECT *, push = 0 OR sqrt(ve * ve + vn * vn) < 1e-6 AS still FROM ({s2})"
    s4 = f"SELECT *, CASE WHEN push = 0 THEN wind WHEN still THEN 0e0 ELSE sqrt(ve * ve + vn * vn) END AS ew, CASE WHEN still THEN tw ELSE {f.positive_mod('degrees(atan2(ve, vn)) + 360e0', 360)} END AS dir0 FROM ({s3})"
    s5 = f"SELECT *, greatest(isi, 0e0) * exp(0.05039e0 * (ew - wind)) AS isi1, {f.length_to_breadth('ew')} AS lb0 FROM ({s4})"
    s6 = f"SELECT *, a * power(1e0 - exp(-b * isi1), c) * moist AS head0 FROM ({s5})"
    s7 = f"SELECT *, head0 * (1e0 - {f.eccentricity('lb0')}) / (1e0 + {f.eccentricity('lb0')}) AS back0 FROM ({s6})"
    return f"SELECT *, {f.rnd('head0', 1)} AS head_ros, {f.rnd('back0', 1)} AS back_ros, {f.rnd('(head0 + back0) / (2e0 * lb0)', 1)} AS flank_ros, {f.rnd('lb0', 2)} AS lb, {f.rnd('dir0', 1)} AS direction, {f.compass_point('dir0')} AS heading, CASE WHEN ew > 40 OR isi1 > 30 THEN 'low' ELSE 'moderate' END AS confidence FROM ({s7})"


query("spread_whatif", "SELECT isi, wind, slope, fuel, head_ros, flank_ros, back_ros, lb, direction, heading, confidence FROM (" + spread_sql(f"SELECT w.*, 30e0 AS wind_from, 1e0 AS moist, CASE WHEN slope > 0 THEN 250e0 END AS aspect, a, b, c FROM (VALUES {values(WHAT_IF)}) w(isi, wind, slope, fuel) JOIN fuelm USING (fuel)") + ")")(spread_whatif)


@query("slope_wind", f"SELECT slope, {f.rnd(f.slope_factor('slope'), 4)} AS factor, {f.rnd(f.slope_wind_kmh('slope'), 2)} AS wind_kmh FROM (SELECT unnest(range(0, 80)) * 1e0 AS slope)")
def slope_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(80).select((F.col("id") * 1.0).alias("slope")).select("slope", F.expr(f.rnd(f.slope_factor("slope"), 4)).alias("factor"), F.expr(f.rnd(f.slope_wind_kmh("slope"), 2)).alias("wind_kmh"))


@query("fuel_models", "SELECT fuel, label, a, b, c FROM fuelm")
def fuel_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.fuels(spark)


def local_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the wind of now and the day's codes at the site of their first detection."""
    site = clustered(spark, sf_dir).where("id = cluster").select("cluster", F.col("user_id").alias("site"))
    hourly = adapters.hourly_weather(spark, sf_dir, site)  # sites without an incident are read but neither grouped nor folded
    wind = weather.reading_now(hourly, adapters.now_hours(spark, sf_dir))
    codes = weather.fire_weather(weather.daily_inputs(hourly)).select("site", F.col("isi").alias("day_isi"), F.col("ffmc").alias("day_ffmc"))
    return incidents(spark, sf_dir).join(site, "cluster").join(wind, "site").join(codes, "site")


HEADLINE = "SELECT weather.*, day_isi AS isi, wind_kmh AS wind, wind_from_deg AS wind_from, 0e0 AS slope, NULL::DOUBLE AS aspect, 1e0 AS moist, fuelm.a, fuelm.b, fuelm.c FROM weather, fuelm WHERE fuelm.fuel = 'maquis'"


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread that exposure is judged by: default fuel, flat ground, the day's index with the wind of now."""
    inputs = local_weather(spark, sf_dir).withColumns({
        "isi": F.col("day_isi"), "wind": F.col("wind_kmh"), "wind_from": F.col("wind_from_deg"), "slope": F.lit(0.0), "aspect": F.lit(None).cast("double"), "moist": F.lit(1.0), "fuel": F.lit(dims.DEFAULT_FUEL),
    })
    return spread.estimate(spread.with_fuel(inputs, dims.fuels(spark), "fuel"))


@query("headline_spread", f"SELECT cluster, head_ros, back_ros, flank_ros, lb, direction, heading, confidence FROM ({spread_sql(HEADLINE)})")
def headline_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headline(spark, sf_dir).select("cluster", "head_ros", "back_ros", "flank_ros", "lb", "direction", "heading", "confidence")


@query("projected_area", f"SELECT cluster, minutes, {f.ellipse_area_ha('head_ros', 'back_ros', 'lb', 'minutes')} AS area_ha FROM ({spread_sql(HEADLINE)}), (VALUES (60), (180), (360)) h(minutes)")
def projected_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = headline(spark, sf_dir).withColumn("minutes", F.explode(F.array(*map(F.lit, dims.HORIZONS_MIN))))
    return each.select("cluster", "minutes", F.expr(f.ellipse_area_ha("head_ros", "back_ros", "lb", "minutes")).alias("area_ha"))


EXPOSED = f"""SELECT *, {f.threat_score('kind', f.rnd('km', 2), 'minutes', 'downwind', 'population')} AS threat FROM (
  SELECT *, CASE WHEN m <= 720 THEN m END AS minutes, abs(off) <= 45 AS downwind FROM (
  SELECT *, {f.minutes_to_reach('rate', 'km')} AS m FROM (SELECT *, {f.rate_toward('head_ros', 'lb', 'off')} AS rate FROM (
  SELECT near.*, head_ros, lb, direction, {f.angle_between('bearing', 'direction')} AS off FROM near JOIN ({spread_sql(HEADLINE)}) h USING (cluster) WHERE km <= 30))))"""


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = geo.places_within(headline(spark, sf_dir), dims.places(spark), dims.EXPOSURE_RADIUS_KM)
    return spread.exposure(near)


@query("minutes_to_reach", f"SELECT cluster, name, {f.rnd('rate', 2)} AS rate, minutes, downwind FROM ({EXPOSED})")
def minutes_to_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposed(spark, sf_dir).select("cluster", "name", F.expr(f.rnd("rate", 2)).alias("rate"), "minutes", "downwind")


@query("exposure_rank", f"SELECT cluster, name, threat, minutes, row_number() OVER (PARTITION BY cluster ORDER BY threat DESC, km, place_no) AS k FROM ({EXPOSED})")
def exposure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy(F.col("threat").desc(), "km", "place_no")
    return exposed(spark, sf_dir).select("cluster", "name", "threat", "minutes", F.row_number().over(order).cast("long").alias("k"))


@query("top_threat", f"SELECT cluster, name, minutes FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY minutes, km, place_no) AS k FROM ({EXPOSED}) WHERE minutes IS NOT NULL AND downwind) WHERE k = 1")
def top_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = exposed(spark, sf_dir).where("minutes IS NOT NULL AND downwind")
    return due.groupBy("cluster").agg(F.min(F.struct("minutes", "km", "place_no", "name")).alias("t")).select("cluster", "t.name", "t.minutes")


# Terrain, cover, moisture.


@query("plane_fit", "SELECT cluster, slope_pct, aspect_deg, relief_m, centre_m FROM plane")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.plane_fit(terrain.heights(incidents(spark, sf_dir)))


@query("terrain_words", f"SELECT cluster, {f.terrain_word('slope_pct')} AS descriptor, {f.rnd('slope_pct * cos(radians(45e0 - aspect_deg))', 1)} AS slope_toward_ne FROM plane")
def terrain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_fit(spark, sf_dir).select("cluster", F.expr(f.terrain_word("slope_pct")).alias("descriptor"), F.expr(f.rnd("slope_pct * cos(radians(45e0 - aspect_deg))", 1)).alias("slope_toward_ne"))


@query("land_cover", "SELECT cluster, cover_code, fuel, label, fuel IS NOT NULL AS burnable FROM cover JOIN lcover ON code = cover_code")
def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land_cover_of(spark, incidents(spark, sf_dir)).select("cluster", "cover_code", "fuel", "label", "burnable")


NDMI = "((cluster % 61) - 20) / 100e0"


@query(
    "live_moisture",
    f"SELECT *, {f.spread_factor('lfm', 'lfmc_dry', 'lfmc_wet', 'reference')} AS factor, {f.moisture_word('lfm')} AS word, lfm > extinction AS above_extinction FROM (SELECT cluster, fuel, {f.rnd(f.live_moisture(NDMI, 'ndmi_dry', 'ndmi_wet', 'lfmc_dry', 'lfmc_wet'), 2)} AS lfm, lfmc_dry, lfmc_wet, reference, extinction FROM inc0, moist)",
)
def live_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = incidents(spark, sf_dir).select("cluster").crossJoin(F.broadcast(dims.moisture_ranges(spark)))
    lfm = both.select("cluster", "fuel", F.expr(f.rnd(f.live_moisture(NDMI, "ndmi_dry", "ndmi_wet", "lfmc_dry", "lfmc_wet"), 2)).alias("lfm"), "lfmc_dry", "lfmc_wet", "reference", "extinction")
    return lfm.withColumns({"factor": F.expr(f.spread_factor("lfm", "lfmc_dry", "lfmc_wet", "reference")), "word": F.expr(f.moisture_word("lfm")), "above_extinction": F.col("lfm") > F.col("extinction")})


# Ensemble.

SCEN_IN = f"""SELECT w.cluster, w.latitude, scenario_no, scenario, wind_kmh * wind_factor AS wind, {f.positive_mod('wind_from_deg + wind_offset', 360)} AS wind_from, slope_pct * slope_factor AS slope, aspect_deg AS aspect,
  CASE WHEN day_ffmc IS NOT NULL THEN {f.isi('day_ffmc', '(wind_kmh * wind_factor)')} ELSE day_isi END AS isi, coalesce(scenario_fuel, cv.fuel, 'maquis') AS fuel_used, {NDMI.replace('cluster', 'w.cluster')} AS ndmi, moisture_factor
  FROM weather w JOIN plane USING (cluster) JOIN (SELECT cluster, fuel FROM cover JOIN lcover ON code = cover_code) cv USING (cluster), scen"""
SCEN_MOIST = f"""SELECT s.*, fuelm.a, fuelm.b, fuelm.c, {f.spread_factor(f"({f.live_moisture('ndmi', 'ndmi_dry', 'ndmi_wet', 'lfmc_dry', 'lfmc_wet')} * moisture_factor)", 'lfmc_dry', 'lfmc_wet', 'reference')} AS moist
  FROM ({SCEN_IN}) s JOIN fuelm ON fuelm.fuel = fuel_used JOIN moist ON moist.fuel = fuel_used"""
SCEN = spread_sql(SCEN_MOIST)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident under the nine scenarios."""
    base = local_weather(spark, sf_dir)
    ground = terrain.plane_fit(terrain.heights(base.select("cluster")))
    cover = land_cover_of(spark, base).select("cluster", "fuel")
    inputs = base.join(ground, "cluster").join(cover, "cluster").withColumn("ndmi", F.expr(NDMI)).withColumnRenamed("day_ffmc", "ffmc")
    return spread.scenario_spread(inputs.select("cluster", "latitude", "longitude", "ffmc", "day_isi", "wind_kmh", "wind_from_deg", "slope_pct", "aspect_deg", "fuel", "ndmi"), dims.scenarios(spark), dims.fuels(spark), dims.moisture_ranges(spark))


@query("scenario_spread", f"SELECT cluster, scenario, fuel_used, head_ros, back_ros, lb, direction FROM ({SCEN})")
def scenario_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(spark, sf_dir).select("cluster", "scenario", "fuel_used", "head_ros", "back_ros", "lb", "direction")


@query("footprint_area", f"SELECT cluster, scenario, minutes, {f.footprint_area_ha('head_ros', 'back_ros', 'lb', 'direction', 'minutes', 'latitude')} AS area_ha FROM ({SCEN}), (VALUES (60), (180), (360)) h(minutes)")
def footprint_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.footprints(ensemble(spark, sf_dir)).select("cluster", "scenario", "minutes", "area_ha")


@query("worst_vs_expected", f"SELECT cluster, min(head_ros) AS slowest, max(head_ros) AS fastest, max(CASE WHEN scenario = 'expected' THEN head_ros END) AS expected, arg_max(scenario, (head_ros, -scenario_no)) AS fastest_scenario FROM ({SCEN}) GROUP BY cluster")
def worst_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(spark, sf_dir).groupBy("cluster").agg(
        F.min("head_ros").alias("slowest"), F.max("head_ros").alias("fastest"), F.max(F.when(F.col("scenario") == "expected", F.col("head_ros"))).alias("expected"), F.max_by("scenario", F.struct(F.col("head_ros"), -F.col("scenario_no"))).alias("fastest_scenario"),
    )


@query("furthest_run", f"SELECT cluster, {f.rnd('max(head_ros) * 360e0 / 1000e0', 2)} AS furthest_km, max(head_ros) * 360e0 / 1000e0 >= 50 AS implausible FROM ({SCEN}) GROUP BY cluster")
def furthest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = "max(head_ros) * 360e0 / 1000e0"
    return ensemble(spark, sf_dir).groupBy("cluster").agg(F.expr(f.rnd(run, 2)).alias("furthest_km"), F.expr(f"{run} >= {f.num(dims.IMPLAUSIBLE_RUN_KM)}").alias("implausible"))


COVERED = "length > 0 AND power(((e * sin(radians(direction)) + n * cos(radians(direction))) - shift) / (length / 2), 2) + power((e * cos(radians(direction)) - n * sin(radians(direction))) / (length / greatest(lb, 1e0) / 2), 2) <= 1"


@query(
    "envelope_core",
    f"""SELECT cluster, minutes, sum(hit_any::INT)::BIGINT AS envelope_cells, sum(hit_all::INT)::BIGINT AS core_cells FROM (
  SELECT cluster, minutes, i, bool_or({COVERED}) AS hit_any, bool_and({COVERED}) AS hit_all FROM (
    SELECT *, (i % 40 + 0.5e0) * cell - cell * 40 / 2 AS e, (i // 40 + 0.5e0) * cell - cell * 40 / 2 AS n, (head_ros + back_ros) * minutes / 1000e0 AS length, (head_ros + back_ros) * minutes / 1000e0 / 2 - back_ros * minutes / 1000e0 AS shift
    FROM (SELECT cluster, minutes, head_ros, back_ros, lb, direction, greatest(max(head_ros * minutes / 1000e0) OVER (PARTITION BY cluster, minutes), 0.01e0) * 2e0 / 40 AS cell FROM ({SCEN}), (VALUES (60), (180), (360)) h(minutes)), (SELECT unnest(range(0, 1600)) AS i))
  GROUP BY cluster, minutes, i) GROUP BY cluster, minutes""",
)
def envelope_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.agreement(spread.footprints(ensemble(spark, sf_dir))).select("cluster", "minutes", "envelope_cells", "core_cells")


CELLS = f"""(SELECT cluster, minutes, kind, i // 40 AS "row", i % 40 AS col FROM (
  SELECT cluster, minutes, i, bool_or({COVERED}) AS hit_any, bool_and({COVERED}) AS hit_all FROM (
    SELECT *, (i % 40 + 0.5e0) * cell - cell * 40 / 2 AS e, (i // 40 + 0.5e0) * cell - cell * 40 / 2 AS n, (head_ros + back_ros) * minutes / 1000e0 AS length, (head_ros + back_ros) * minutes / 1000e0 / 2 - back_ros * minutes / 1000e0 AS shift
    FROM (SELECT cluster, minutes, head_ros, back_ros, lb, direction, greatest(max(head_ros * minutes / 1000e0) OVER (PARTITION BY cluster, minutes), 0.01e0) * 2e0 / 40 AS cell FROM ({SCEN}), (VALUES (60), (180), (360)) h(minutes)), (SELECT unnest(range(0, 1600)) AS i))
  GROUP BY cluster, minutes, i), (VALUES ('envelope'), ('core')) k(kind) WHERE (kind = 'envelope' AND hit_any) OR (kind = 'core' AND hit_all))"""


@query("projection_outlines", f"SELECT * FROM (SELECT cluster, minutes, kind, count(*) AS cells FROM {CELLS} GROUP BY ALL) JOIN (SELECT cluster, minutes, kind, {OUTLINE} FROM ({AROUND.format(keys='cluster, minutes, kind', cells=CELLS)}) GROUP BY ALL) USING (cluster, minutes, kind)")
def projection_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope and core of every incident and horizon as polygons: area, corners and length in sides, by their rings."""
    found = spread.agreement_outlines(spread.footprints(ensemble(spark, sf_dir)))
    return found.groupBy("cluster", "minutes", "kind").agg(F.sum("cells").alias("cells"), F.sum("corners").alias("corners"), F.sum(regions.perimeter("rings")).alias("sides"))


THREATS = f"""SELECT cluster, place_no, name, count(*) AS hit_count, 9::BIGINT AS scenario_count, min(m) AS earliest, list_sort(list(m))[count(*) // 2 + 1] AS median, string_agg(scenario, ',' ORDER BY m, scenario_no) AS scenarios_hit, {f.rnd('count(*) / 9e0', 3)} AS likelihood
  FROM (SELECT *, {f.minutes_to_reach('rate', 'km')} AS m FROM (SELECT *, {f.rate_toward('head_ros', 'lb', 'off')} AS rate FROM (
    SELECT s.cluster, scenario, scenario_no, head_ros, lb, place_no, name, km, {f.angle_between('bearing', 'direction')} AS off FROM ({SCEN}) s JOIN near USING (cluster) WHERE km <= 80))) WHERE m <= 2880 GROUP BY cluster, place_no, name"""


@query("threats", THREATS)
def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 80 km and arrivals within two days, so that slow fronts count too."""
    near = geo.places_within(incidents(spark, sf_dir), dims.places(spark), 80.0)
    return spread.threats(ensemble(spark, sf_dir), near, 2880)
