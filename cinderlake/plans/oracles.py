"""Building blocks of the DuckDB SQL that results are held against.

``sql(body)`` puts the common table expressions that ``body`` names in front of it, with all that these name.
"""

from __future__ import annotations

import math
import re

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.operators.cluster import PLAUSIBILITY, VERDICT

K = f.num(math.pi * dims.EARTH_RADIUS_KM / 180.0)
KM = f.num(dims.KM_PER_DEGREE)


def values(rows) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) if isinstance(v, (bool, int)) else f.num(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


SPREAD_KM = f"sqrt(power((max(latitude) - min(latitude)) * {KM}, 2) + power((max(longitude) - min(longitude)) * {KM} * cos(radians(avg(latitude))), 2))"

TABLES = {
    "alldet(id, user_id, event_type, us, hours, latitude, longitude, frp_mw, satellite, scan_km, is_daytime, day)": """
  SELECT event_id, user_id, event_type, epoch_us(ts), (epoch_us(ts) - 1704067200000000) / 3.6e9,
    (CASE WHEN user_id % 10 = 0 THEN 37700 + user_id * 37 % 80 * 10 ELSE 35000 + user_id * 37 % 650 * 10 END + event_id * 17 % 41 - 20) / 1000e0,
    (CASE WHEN user_id % 10 = 0 THEN 23300 + user_id * 53 % 80 * 10 ELSE 20000 + user_id * 53 % 900 * 10 END + event_id * 29 % 37 - 18) / 1000e0, value,
    CASE event_type WHEN 'view' THEN 'viirs_snpp' WHEN 'click' THEN 'viirs_noaa20' WHEN 'signup' THEN 'viirs_noaa21' WHEN 'purchase' THEN 'modis_terra' ELSE 'modis_aqua' END,
    CASE event_id % 5 WHEN 0 THEN 0.375e0 WHEN 1 THEN 0e0 WHEN 3 THEN 0.5e0 WHEN 4 THEN 1e0 END, hour(ts) BETWEEN 6 AND 17, (epoch_us(ts) - 1704067200000000) // 86400000000
  FROM events""",
    "det": "SELECT * FROM alldet WHERE us > (SELECT max(epoch_us(ts)) FROM events) - 5 * 86400000000",
    "day_mark": "SELECT d, mx, max(mx) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT us // 432000000000 AS d, max(us) AS mx FROM alldet GROUP BY 1)",
    "nowh(now)": "SELECT (max(epoch_us(ts)) - 1704067200000000) / 3.6e9 FROM events",
    "xyh": f"""
  SELECT id, (longitude - avg(longitude) OVER ()) * {K} * cos(radians(avg(latitude) OVER ())) AS x, (latitude - avg(latitude) OVER ()) * {K} AS y, hours - min(hours) OVER () AS h FROM det""",
    "edge(a, b)": "SELECT p.id, q.id FROM xyh p JOIN xyh q ON p.id < q.id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 9e0 AND abs(p.h - q.h) <= 30e0",
    "twoway(a, b)": "SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge",
    "reach(id, other)": "SELECT id, id FROM det UNION SELECT r.id, t.b FROM reach r JOIN twoway t ON t.a = r.other",
    "label": "SELECT id, CASE WHEN count(*) = 1 THEN -1 ELSE min(other) END AS cluster FROM reach GROUP BY id",
    "fixedxyh": f"SELECT id, longitude * {K} * cos(radians({f.num((dims.AOI_SOUTH + dims.AOI_NORTH) / 2)})) AS x, latitude * {K} AS y, us / 3.6e9 AS h FROM det",
    "fixededge(a, b)": "SELECT p.id, q.id FROM fixedxyh p JOIN fixedxyh q ON p.id < q.id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 9e0 AND abs(p.h - q.h) <= 30e0",
    "fixedtwoway(a, b)": "SELECT a, b FROM fixededge UNION ALL SELECT b, a FROM fixededge",
    "fixedreach(id, other)": "SELECT id, id FROM det UNION SELECT r.id, t.b FROM fixedreach r JOIN fixedtwoway t ON t.a = r.other",
    "fixedlabel": "SELECT id, CASE WHEN count(*) = 1 THEN -1 ELSE min(other) END AS cluster FROM fixedreach GROUP BY id",
    "mem": "SELECT det.*, cluster FROM det JOIN label USING (id)",
    "cellkey": f"""
  SELECT cluster, us, id, size, trunc(latitude / (size / {KM}))::BIGINT AS ci, trunc(longitude / (size / ({KM} * cos(radians(latitude)))))::BIGINT AS cj
  FROM (SELECT *, greatest(coalesce(nullif(scan_km, 0e0), 0.375e0), 0.375e0) AS size FROM mem WHERE cluster >= 0)""",
    "area": f"""
  SELECT cluster, {f.rnd('sum(size * size) * 100e0', 1)} AS area_ha
  FROM (SELECT cluster, ci, cj, arg_min(size, (us, id)) AS size FROM cellkey GROUP BY ALL) GROUP BY cluster""",
    "inc0": f"""
  SELECT cluster, count(*) AS detection_count, min(hours) AS first_h, max(hours) AS last_h, {f.rnd('coalesce(sum(frp_mw), 0e0)', 1)} AS total_frp, {f.rnd('coalesce(max(frp_mw), 0e0)', 1)} AS max_frp,
    sum(greatest(coalesce(frp_mw, 0e0), 0.1e0) * latitude) / sum(greatest(coalesce(frp_mw, 0e0), 0.1e0)) AS lat0,
    sum(greatest(coalesce(frp_mw, 0e0), 0.1e0) * longitude) / sum(greatest(coalesce(frp_mw, 0e0), 0.1e0)) AS lon0,
    arg_min(latitude, (us, id)) AS alat, arg_min(longitude, (us, id)) AS alon, min(us) AS first_us
  FROM mem WHERE cluster >= 0 GROUP BY cluster""",
    "inc1": f"""
  SELECT *, {f.rnd('lat0', 6)} AS latitude, {f.rnd('lon0', 6)} AS longitude, {f.rnd('area_ha / greatest(last_h - first_h, 1e0)', 2)} AS growth,
    {f.status('((SELECT now FROM nowh) - last_h)')} AS status FROM inc0 JOIN area USING (cluster)""",
    "inc": f"""
  SELECT *, {f.severity('score')} AS severity, left(sha1(concat(printf('%.3f', alat), ':', printf('%.3f', alon), ':', CASE WHEN first_us % 1000000 = 0 THEN strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S.%f+00:00') END)), 16) AS incident_id
  FROM (SELECT *, {f.rnd(f.severity_score('area_ha', 'total_frp', 'growth'), 2)} AS score FROM inc1)""",
    "sig": f"""
  SELECT cluster, count(*) AS n, {f.rnd('max(coalesce(frp_mw, 0e0))', 2)} AS peak_frp, list_sort(list(coalesce(frp_mw, 0e0)))[count(*) // 2 + 1] AS median_frp,
    {f.rnd('coalesce(sum(CASE WHEN NOT is_daytime THEN 1e0 ELSE 0e0 END) / nullif(count(is_daytime), 0), 0e0)', 2)} AS night_fraction,
    count(DISTINCT day) AS days, {f.rnd('max(hours) - min(hours)', 1)} AS span_h, {f.rnd(SPREAD_KM, 2)} AS spread_km, count(DISTINCT satellite) AS satellites
  FROM mem WHERE cluster >= 0 GROUP BY cluster""",
    f"lcover(code, fuel, label)": f"VALUES {values([(c, x, None) for c, x in dims.LAND_COVER_FUEL] + [(c, None, x) for c, x in dims.NON_BURNABLE])}",
    "cover": "SELECT cluster, (SELECT list(code ORDER BY code) FROM lcover)[cluster % 44 + 1] AS cover_code FROM inc0",
    "judged": f"""
  SELECT * EXCLUDE (raw), {f.rnd('raw', 3)} AS plausibility, verdict IN ('questionable', 'likely_not_wildfire') AS is_suspect
  FROM (SELECT *, {VERDICT} AS verdict FROM (SELECT *, {PLAUSIBILITY} AS raw FROM
    (SELECT sig.*, cover_code, fuel IS NOT NULL AS burnable, fuel, label FROM sig JOIN cover USING (cluster) JOIN lcover ON code = cover_code)))""",
    "place(place_no, name, latitude, longitude, kind, population, region)": f"VALUES {values((i, *p) for i, p in enumerate(dims.PLACES))}",
    "fuelm(fuel, label, a, b, c)": f"VALUES {values(dims.FUELS)}",
    "moist(fuel, ndmi_dry, ndmi_wet, lfmc_dry, lfmc_wet, extinction, reference)": f"VALUES {values(dims.MOISTURE)}",
    "scen(scenario_no, scenario, scenario_fuel, wind_factor, wind_offset, slope_factor, moisture_factor)": f"VALUES {values((i, *s) for i, s in enumerate(dims.SCENARIOS))}",
    "overlay(overlay_no, id, category, layer, time_aware, opacity, source)": f"VALUES {values((i, *o) for i, o in enumerate(dims.OVERLAYS))}",
    "side(x1, y1, x2, y2)": f"VALUES {values(tuple(map(float, (*a, *b))) for ring in dims.BOUNDARY for a, b in zip(ring, ring[1:] + ring[:1], strict=True))}",
    "near": f"""
  SELECT inc.cluster, inc.status, inc.severity, inc.area_ha, inc.growth, place_no, name, kind, population, {f.haversine_km('inc.latitude', 'inc.longitude', 'place.latitude', 'place.longitude')} AS km,
    {f.bearing_deg('inc.latitude', 'inc.longitude', 'place.latitude', 'place.longitude')} AS bearing FROM inc, place""",
    "wx": """
  SELECT user_id AS site, hour, hour // 24 AS day, hour % 24 AS hour_of_day, (180 + n * 13 % 200) / 10e0 AS temperature_c,
    CASE WHEN n % 23 <> 0 THEN (15 + n * 7 % 70) * 1e0 END AS humidity_pct, CASE WHEN n % 19 <> 0 THEN (n * 11 % 45) * 1e0 END AS wind_kmh, (n * 31 % 360) * 1e0 AS wind_from_deg,
    (CASE WHEN n % 9 = 0 THEN n % 12 ELSE 0 END) * 1e0 AS rain_mm, (hour // 24 // 30 % 12 + 6)::INTEGER AS month, (CASE WHEN user_id % 10 = 0 THEN 37700 + user_id * 37 % 80 * 10 ELSE 35000 + user_id * 37 % 650 * 10 END) / 1000e0 AS latitude
  FROM (SELECT user_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS hour, min(event_id) AS n FROM events GROUP BY ALL)""",
    "noon": """
  SELECT * FROM (SELECT *, sum(rain_mm) OVER (PARTITION BY site, day) AS day_rain, row_number() OVER (PARTITION BY site, day ORDER BY abs(hour_of_day - 10), hour) AS k FROM wx)
  WHERE k = 1 AND temperature_c IS NOT NULL AND humidity_pct IS NOT NULL""",
    "codes": f"""
  SELECT site, {f.fwi_fold(f.DUCK, 'days')} AS last, n_days FROM (
    SELECT site, count(*) AS n_days, list({f.DUCK.struct(t='temperature_c', rh='humidity_pct', w='coalesce(wind_kmh, 0e0)', rain='day_rain', dl=f.day_factor(f.DUCK, f.DMC_DAY_46, f.DMC_DAY_20, 'month', 'latitude'), cl=f.day_factor(f.DUCK, f.DC_DAY_46, f.DC_DAY_20, 'month', 'latitude'), ffmc='0e0', dmc='0e0', dc='0e0', isi='0e0', bui='0e0', fwi='0e0')} ORDER BY day) AS days
    FROM noon GROUP BY site)""",
    "danger": f"""
  SELECT site, n_days, last.ffmc AS ffmc, last.dmc AS dmc, last.dc AS dc, {f.rnd('last.isi', 2)} AS isi, {f.rnd('last.bui', 2)} AS bui, {f.rnd('last.fwi', 2)} AS fwi, {f.danger_class('last.fwi')} AS danger_class FROM codes""",
    "weather": """
  SELECT inc.*, w.wind_kmh, w.wind_from_deg, d.isi AS day_isi, d.ffmc AS day_ffmc FROM (SELECT inc.*, user_id AS site FROM inc JOIN (SELECT id, user_id FROM det) ON id = cluster) inc
  JOIN (SELECT site, arg_min(coalesce(wind_kmh, 0e0), (abs(hour - (SELECT now FROM nowh)), hour)) AS wind_kmh, arg_min(wind_from_deg, (abs(hour - (SELECT now FROM nowh)), hour)) AS wind_from_deg FROM wx GROUP BY site) w USING (site)
  JOIN danger d USING (site)""",
    "terrain": """
  SELECT cluster, slope_pct, aspect_deg, relief_m, centre_m FROM plane""",
    "dem": """
  SELECT cluster, i, j, (cluster % 500) + i * 4e2 * ((cluster % 31) - 15) / 1e2 + j * 4e2 * ((cluster % 23) - 11) / 1e2 + ((cluster * 7 + i * 3 + j * 5) % 9) AS z
  FROM inc0, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)""",
    "plane0": """
  SELECT cluster, regr_slope(z, i * 4e2) AS dzdx, regr_slope(z, j * 4e2) AS dzdy, max(z) - min(z) AS relief, max(CASE WHEN i = 0 AND j = 0 THEN z END) AS centre FROM dem GROUP BY cluster""",
    "plane": f"""
  SELECT cluster, {f.rnd('100e0 * sqrt(dzdx * dzdx + dzdy * dzdy)', 1)} AS slope_pct, {f.rnd(f.positive_mod('degrees(atan2(dzdx, dzdy))', 360), 1)} AS aspect_deg, {f.rnd('relief', 1)} AS relief_m, {f.rnd('centre', 1)} AS centre_m FROM plane0""",
}

# What a polygon's rings must add up to, from its cells alone: each grid corner by which of the four cells around it are in (1 and 2
# below left and right, 4 and 8 above). One or three cells bend an outline there, two opposite ones twice; half as many sides as leave a corner are counted with it.
AROUND = """SELECT {keys}, r + dy AS y, c + dx AS x, sum(bit) AS around FROM (SELECT {keys}, "row" AS r, col AS c FROM {cells}), (VALUES (1, 1, 1), (1, 0, 2), (0, 1, 4), (0, 0, 8)) b(dy, dx, bit) GROUP BY ALL"""
OUTLINE = "sum(CASE WHEN around IN (1, 2, 4, 8, 7, 11, 13, 14) THEN 1 WHEN around IN (6, 9) THEN 2 ELSE 0 END)::BIGINT AS corners, sum(CASE around WHEN 15 THEN 0 WHEN 6 THEN 2 WHEN 9 THEN 2 ELSE 1 END)::BIGINT AS sides"

_by_name = {k.split("(")[0]: (k, v) for k, v in TABLES.items()}


def sql(body: str) -> str:
    """``body`` behind a WITH clause of the tables that it needs, in order of need."""
    order: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for name in _by_name:
            if name not in seen and name not in order and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                need(_by_name[name][1], (*seen, name))
                if name not in order:
                    order.append(name)

    need(body, ())
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{_by_name[n][0]} AS ({_by_name[n][1]})" for n in order) + "\n" + body
