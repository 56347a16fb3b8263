"""Scalar formulas as SQL text that Spark and DuckDB read alike.

Each function takes SQL expressions and returns one; Spark evaluates it through ``expr`` inside whole-stage code
generation. Numbers are written with an exponent, which makes them doubles in both. ``rnd`` rounds half up with a
nudge far below any shown digit, so that sums taken in another order round alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from cinderlake import dims


def num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def rnd(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5e0 + 1e-7) / {scale})"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {num(low)}), {num(high)})"


def positive_mod(x: str, n: float) -> str:
    return f"(({x}) - {num(n)} * floor(({x}) / {num(n)}))"


# Distance and direction.


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = lambda a, b: f"power(sin(radians(({b}) - ({a})) / 2e0), 2)"
    a = f"({half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)})"
    return f"({num(2 * dims.EARTH_RADIUS_KM)} * asin(least(1e0, sqrt({a}))))"


def bearing_deg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"radians(({lon2}) - ({lon1}))"
    y = f"(sin({d}) * cos(radians({lat2})))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))"
    return positive_mod(f"degrees(atan2({y}, {x})) + 360e0", 360)


def compass_point(bearing: str) -> str:
    index = f"floor({positive_mod(f'({bearing}) + 11.25e0', 360)} / 22.5e0)"
    return f"CASE {' '.join(f'WHEN {index} = {i} THEN {p!r}' for i, p in enumerate(dims.COMPASS))} END"


def angle_between(a: str, b: str) -> str:
    """Signed difference a - b in [-180, 180)."""
    return f"({positive_mod(f'({a}) - ({b}) + 180e0', 360)} - 180e0)"


# Spread.


def slope_factor(slope: str) -> str:
    return f"CASE WHEN ({slope}) <= 0 THEN 1e0 ELSE exp(3.533e0 * power(least(greatest({slope}, 0e0) / 100e0, 0.6e0), 1.2e0)) END"


def slope_wind_kmh(slope: str) -> str:
    return f"(ln({slope_factor(slope)}) / 0.05039e0)"


def isi(ffmc: str, wind: str) -> str:
    m = f"(147.2e0 * (101e0 - ({ffmc})) / (59.5e0 + ({ffmc})))"
    return f"(0.208e0 * exp(0.05039e0 * ({wind})) * 91.9e0 * exp(-0.1386e0 * {m}) * (1e0 + power({m}, 5.31e0) / 4.93e7))"


def length_to_breadth(wind: str) -> str:
    return f"greatest(1e0, 1e0 + 8.729e0 * power(1e0 - exp(-0.03e0 * ({wind})), 2.155e0))"


def eccentricity(lb: str) -> str:
    return f"(sqrt(greatest(power({lb}, 2) - 1e0, 0e0)) / ({lb}))"


def rate_toward(head: str, lb: str, offset: str) -> str:
    """Spread rate at an angle from the head."""
    e = eccentricity(lb)
    below = f"(1e0 - {e} * cos(radians({offset})))"
    return f"CASE WHEN {below} <= 1e-9 THEN ({head}) ELSE ({head}) * (1e0 - {e}) / {below} END"


def minutes_to_reach(rate: str, km: str) -> str:
    return f"CASE WHEN ({rate}) < 0.5e0 THEN NULL ELSE {rnd(f'({km}) * 1000e0 / ({rate})', 1)} END"


def ellipse_area_ha(head: str, back: str, lb: str, minutes: str) -> str:
    length = f"((({head}) + ({back})) * ({minutes}))"
    return rnd(f"pi() * ({length} / 2e0) * ({length} / ({lb}) / 2e0) / 1e4", 1)


#: Area of a regular 96-gon in its circle.
POLYGON_SHARE = 0.9992862247


def footprint_area_ha(head: str, back: str, lb: str, direction: str, minutes: str, lat: str) -> str:
    """Area of the 96-gon footprint in degrees, scaled at its centroid's latitude."""
    length = f"((({head}) + ({back})) * ({minutes}) / 1000e0)"
    shift = f"({length} / 2e0 - ({back}) * ({minutes}) / 1000e0)"
    centre = f"(({lat}) + {shift} * cos(radians({direction})) / {num(dims.KM_PER_DEGREE)})"
    return rnd(f"pi() * ({length} / 2e0) * ({length} / greatest({lb}, 1e0) / 2e0) * {num(POLYGON_SHARE)} * 100e0 * cos(radians({centre})) / cos(radians({lat}))", 1)


# Severity, status, exposure.


def severity_score(area: str, frp: str, growth: str) -> str:
    return f"(least(({area}) / 5000e0, 1e0) * 40e0 + least(({frp}) / 1000e0, 1e0) * 30e0 + least(({growth}) / 120e0, 1e0) * 30e0)"


def severity(score: str) -> str:
    return f"CASE WHEN {score} >= 70 THEN 'critical' WHEN {score} >= 50 THEN 'major' WHEN {score} >= 30 THEN 'moderate' WHEN {score} >= 12 THEN 'minor' ELSE 'informational' END"


def severity_rank(name: str) -> str:
    return f"CASE {name} {' '.join(f'WHEN {v!r} THEN {i}' for i, v in enumerate(dims.VOCABULARIES['incident_severity']))} ELSE 0 END"


def status(quiet_hours: str) -> str:
    return f"CASE WHEN {quiet_hours} >= {num(dims.QUIET_OUT_H)} THEN 'out' WHEN {quiet_hours} >= {num(dims.QUIET_CONTAINED_H)} THEN 'contained' ELSE 'active' END"


def category_weight(kind: str) -> str:
    return f"CASE {kind} {' '.join(f'WHEN {k!r} THEN {num(w)}' for k, w in dims.CATEGORY_WEIGHTS)} ELSE 0.3e0 END"


def threat_score(kind: str, km: str, minutes: str, downwind: str, population: str) -> str:
    near = clamp(f"(30e0 - ({km})) / 28e0", 0, 1)
    path = f"CASE WHEN {minutes} IS NOT NULL THEN greatest(0e0, 1e0 - {minutes} / 720e0) WHEN {downwind} THEN 0.5e0 ELSE 0.15e0 END"
    people = f"CASE WHEN coalesce({population}, 0) > 0 THEN least(1e0, log10({population} + 1e0) / 5e0) ELSE 0.25e0 END"
    return rnd(f"least(1e0, 0.3e0 * ({category_weight(kind)}) + 0.25e0 * {near} + 0.3e0 * ({path}) + 0.15e0 * ({people}))", 4)


# Fuel moisture, burn severity, terrain.


def live_moisture(ndmi: str, dry: str, wet: str, lfmc_dry: str, lfmc_wet: str) -> str:
    span = f"(({wet}) - ({dry}))"
    share = f"CASE WHEN {span} = 0 THEN 0.5e0 ELSE {clamp(f'(({ndmi}) - ({dry})) / {span}', 0, 1)} END"
    return f"(({lfmc_dry}) + ({share}) * (({lfmc_wet}) - ({lfmc_dry})))"


def spread_factor(lfm: str, lfmc_dry: str, lfmc_wet: str, reference: str) -> str:
    span = f"(({lfmc_wet}) - ({lfmc_dry}))"
    return f"CASE WHEN {span} <= 0 THEN 1e0 ELSE {rnd(clamp(f'1e0 + (({reference}) - ({lfm})) / {span} * 0.7e0', 0.65, 1.35), 3)} END"


def moisture_word(lfm: str) -> str:
    return f"CASE WHEN {lfm} < 60 THEN 'tinder dry' WHEN {lfm} < 90 THEN 'dry' WHEN {lfm} < 120 THEN 'normal' ELSE 'green' END"


def terrain_word(slope: str) -> str:
    return f"CASE WHEN {slope} < 5 THEN 'flat' WHEN {slope} < 15 THEN 'gently sloping' WHEN {slope} < 30 THEN 'hilly' WHEN {slope} < 50 THEN 'steep' ELSE 'very steep' END"


def normalised_difference(a: str, b: str) -> str:
    """(a - b) / (a + b) of reflectances not below zero, in [-1, 1]; null where the sum vanishes."""
    x, y = f"greatest({a}, 0e0)", f"greatest({b}, 0e0)"
    return f"CASE WHEN {x} + {y} > 1e-6 THEN {clamp(f'({x} - {y}) / ({x} + {y})', -1, 1)} END"


def burn_class(dnbr: str) -> str:
    steps = " ".join(f"WHEN {dnbr} >= {num(low)} THEN {name!r}" for name, low, _ in reversed(dims.SEVERITY_BREAKS))
    return f"CASE {steps} ELSE 'unburned' END"


def relative_dnbr(dnbr: str, pre: str) -> str:
    return f"(({dnbr}) / sqrt(abs(CASE WHEN abs({pre}) < 0.001e0 THEN 0.001e0 ELSE {pre} END)))"


def scar_confidence(usable: str, gap_days: str, burning: str) -> str:
    late = f"CASE WHEN {gap_days} > 30 THEN 0.15e0 WHEN {gap_days} > 14 THEN 0.05e0 ELSE 0e0 END"
    return rnd(clamp(f"0.95e0 * ({usable}) - ({late}) - CASE WHEN {burning} THEN 0.1e0 ELSE 0e0 END", 0.1, 1), 2)


# Display.


def format_area(ha: str) -> str:
    whole = f"CAST(floor({ha} + 0.5e0) AS BIGINT)"
    grouped = f"CASE WHEN {whole} >= 1000 THEN concat(CAST(CAST(floor({whole} / 1000e0) AS BIGINT) AS STRING), ',', lpad(CAST({whole} % 1000 AS STRING), 3, '0')) ELSE CAST({whole} AS STRING) END"
    return f"CASE WHEN {ha} >= 10000 THEN concat(CAST({rnd(f'{ha} / 1000e0', 1)} AS STRING), 'k ha') WHEN {ha} >= 100 THEN concat({grouped}, ' ha') ELSE concat(CAST({rnd(ha, 1)} AS STRING), ' ha') END"


def format_lead(minutes: str) -> str:
    five = f"CAST(CAST(floor({minutes} / 5e0 + 0.5e0) * 5 AS BIGINT) AS STRING)"
    half = f"CAST(floor({minutes} / 30e0 + 0.5e0) / 2e0 AS STRING)"
    return f"CASE WHEN {minutes} IS NULL THEN '—' WHEN {minutes} < 60 THEN concat({five}, ' min') WHEN {minutes} < 360 THEN concat({half}, ' h') ELSE concat(CAST(CAST(floor({minutes} / 60e0 + 0.5e0) AS BIGINT) AS STRING), ' h') END"


#: Stops of the heat colour ramp.
HEAT_STOPS = ((0.0, (120, 60, 40)), (0.35, (220, 90, 30)), (0.7, (252, 176, 64)), (1.0, (255, 244, 214)))


def heat_share(frp: str) -> str:
    return f"least(1e0, log10(greatest({frp}, 1e0) + 1e0) / log10(600e0))"


def heat_colour(frp: str, channel: int, t: str | None = None) -> str:
    """One channel of a detection's colour; ``t`` may name a column that already holds ``heat_share``."""
    t = t or heat_share(frp)
    legs = []
    for (t0, c0), (t1, c1) in zip(HEAT_STOPS, HEAT_STOPS[1:], strict=False):
        legs.append(f"WHEN {t} <= {num(t1)} THEN {rnd(f'{num(c0[channel])} + {num(c1[channel] - c0[channel])} * (({t} - {num(t0)}) / {num(t1 - t0)})', 0)}")
    missing = (120, 130, 155)[channel]
    return f"CAST(CASE WHEN {frp} IS NULL THEN {num(missing)} {' '.join(legs)} ELSE {num(HEAT_STOPS[-1][1][channel])} END AS INT)"


# Fire weather: one day of the index system.


@dataclass(frozen=True)
class Dialect:
    """What the two engines write differently: bound names, structs and folds over arrays."""

    spark: bool

    def let(self, name: str, value: str, body: str) -> str:
        if self.spark:
            return f"transform(array({value}), {name} -> {body})[0]"
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return f"named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())})"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def fold(self, items: str, first: str, state: str, item: str, body: str) -> str:
        if self.spark:
            return f"aggregate({items}, {first}, ({state}, {item}) -> {body})"
        return f"list_reduce({items}, lambda {state}, {item}: {body}, {first})"

    def pick(self, values: tuple[float, ...], index: str) -> str:
        items = ", ".join(map(num, values))
        return f"element_at(array({items}), {index})" if self.spark else f"[{items}][{index}]"


SPARK, DUCK = Dialect(True), Dialect(False)

# Day-length factors by month, at 46 and 20 degrees.
DMC_DAY_46 = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DMC_DAY_20 = (7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8)
DC_DAY_46 = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
DC_DAY_20 = (6.4,) * 12
FWI_START = (85.0, 6.0, 15.0)


def day_factor(d: Dialect, high: tuple[float, ...], low: tuple[float, ...], month: str, lat: str) -> str:
    share = clamp(f"(abs({lat}) - 20e0) / 26e0", 0, 1)
    return f"({d.pick(low, month)} + ({d.pick(high, month)} - {d.pick(low, month)}) * {share})"


def ffmc(d: Dialect, prev: str, t: str, rh: str, w: str, rain: str) -> str:
    excess = f"greatest({rain} - 0.5e0, 1e-9)"
    drying = f"(0.18e0 * (21.1e0 - {t}) * (1e0 - exp(-0.115e0 * h)))"
    rate = lambda dry: f"((0.424e0 * (1e0 - power({dry}, 1.7e0)) + 0.0694e0 * sqrt({w}) * (1e0 - power({dry}, 8))) * 0.581e0 * exp(0.0365e0 * {t}))"
    result = clamp("59.5e0 * (250e0 - m) / (147.2e0 + m)", 0, 101)
    moved = (
        f"CASE WHEN mo > ed THEN ed + (mo - ed) * power(10e0, -{rate('h / 100e0')}) "
        f"WHEN mo < ew THEN ew - (ew - mo) * power(10e0, -{rate('(100e0 - h) / 100e0')}) ELSE mo END"
    )
    body = d.let("m", moved, result)
    body = d.let("ew", f"0.618e0 * power(h, 0.753e0) + 10e0 * exp((h - 100e0) / 10e0) + {drying}", body)
    body = d.let("ed", f"0.942e0 * power(h, 0.679e0) + 11e0 * exp((h - 100e0) / 10e0) + {drying}", body)
    body = d.let("mo", f"least(CASE WHEN {rain} > 0.5e0 AND mb > 150 THEN mb + 0.0015e0 * power(mb - 150e0, 2) * sqrt({excess}) ELSE mb END, 250e0)", body)
    body = d.let("mb", f"CASE WHEN {rain} > 0.5e0 THEN ma + 42.5e0 * {excess} * exp(-100e0 / (251e0 - ma)) * (1e0 - exp(-6.93e0 / {excess})) ELSE ma END", body)
    body = d.let("ma", f"147.2e0 * (101e0 - {prev}) / (59.5e0 + {prev})", body)
    return d.let("h", f"least({rh}, 100e0)", body)


def dmc(d: Dialect, prev: str, t: str, rh: str, rain: str, day: str) -> str:
    b = "CASE WHEN p0 <= 33 THEN 100e0 / (0.5e0 + 0.3e0 * p0) WHEN p0 <= 65 THEN 14e0 - 1.3e0 * ln(p0) ELSE 6.2e0 * ln(p0) - 17.2e0 END"
    wet = f"(20e0 + exp(5.6348e0 - p0 / 43.43e0) + 1000e0 * (0.92e0 * {rain} - 1.27e0) / (48.77e0 + ({b}) * (0.92e0 * {rain} - 1.27e0)))"
    after = f"CASE WHEN {rain} > 1.5e0 THEN greatest(0e0, 244.72e0 - 43.43e0 * ln(greatest({wet} - 20e0, 1e-9))) ELSE p0 END"
    grown = f"greatest(0e0, p1 + 100e0 * 1.894e0 * (greatest({t}, -1.1e0) + 1.1e0) * (100e0 - least({rh}, 100e0)) * {day} * 1e-6)"
    return d.let("p0", f"greatest({prev}, 1e-9)", d.let("p1", after, grown))


def dc(d: Dialect, prev: str, t: str, rain: str, day: str) -> str:
    left = f"(800e0 * exp(-({prev}) / 400e0) + 3.937e0 * (0.83e0 * {rain} - 1.27e0))"
    after = f"CASE WHEN {rain} > 2.8e0 THEN greatest(0e0, 400e0 * ln(800e0 / greatest({left}, 1e-9))) ELSE {prev} END"
    return d.let("d1", after, f"greatest(0e0, d1 + 0.5e0 * greatest(0e0, 0.36e0 * (greatest({t}, -2.8e0) + 2.8e0) + {day}))")


def bui(p: str, c: str) -> str:
    low = f"(0.8e0 * {p} * {c} / ({p} + 0.4e0 * {c}))"
    high = f"({p} - (1e0 - 0.8e0 * {c} / ({p} + 0.4e0 * {c})) * (0.92e0 + power(0.0114e0 * {p}, 1.7e0)))"
    return f"CASE WHEN {p} <= 0 AND {c} <= 0 THEN 0e0 WHEN {p} <= 0.4e0 * {c} THEN {low} ELSE greatest(0e0, {high}) END"


def fwi(i: str, u: str) -> str:
    f = f"CASE WHEN {u} <= 80 THEN 0.626e0 * power({u}, 0.809e0) + 2e0 ELSE 1000e0 / (25e0 + 108.64e0 * exp(-0.023e0 * {u})) END"
    b = f"(0.1e0 * {i} * ({f}))"
    return f"CASE WHEN {b} <= 1 THEN greatest(0e0, {b}) ELSE exp(2.72e0 * power(0.434e0 * ln(greatest({b}, 1e0)), 0.647e0)) END"


def danger_class(x: str) -> str:
    return f"CASE WHEN {x} < 5.2e0 THEN 'very_low' WHEN {x} < 11.2e0 THEN 'low' WHEN {x} < 21.3e0 THEN 'moderate' WHEN {x} < 38 THEN 'high' WHEN {x} < 50 THEN 'very_high' ELSE 'extreme' END"


#: Fields of a day before and after its step; the state is carried rounded.
DAY_FIELDS = ("t", "rh", "w", "rain", "dl", "cl", "ffmc", "dmc", "dc", "isi", "bui", "fwi")


def fwi_step(d: Dialect, state: str, day: str) -> str:
    """A day's struct with the codes after it: codes rounded to two places, indices from the unrounded codes."""
    done = d.struct(
        t=f"{day}.t", rh=f"{day}.rh", w=f"{day}.w", rain=f"{day}.rain", dl=f"{day}.dl", cl=f"{day}.cl",
        ffmc=rnd("nf", 2), dmc=rnd("np", 2), dc=rnd("nc", 2), isi="ni", bui="nu", fwi=fwi("ni", "nu"),
    )
    body = d.let("ni", isi("nf", f"{day}.w"), d.let("nu", bui("np", "nc"), done))
    body = d.let("nc", dc(d, f"{state}.dc", f"{day}.t", f"{day}.rain", f"{day}.cl"), body)
    body = d.let("np", dmc(d, f"{state}.dmc", f"{day}.t", f"{day}.rh", f"{day}.rain", f"{day}.dl"), body)
    return d.let("nf", ffmc(d, f"{state}.ffmc", f"{day}.t", f"{day}.rh", f"{day}.w", f"{day}.rain"), body)


def fwi_first(d: Dialect) -> str:
    zero = {k: "0e0" for k in DAY_FIELDS}
    return d.struct(**(zero | {"ffmc": num(FWI_START[0]), "dmc": num(FWI_START[1]), "dc": num(FWI_START[2])}))


def fwi_fold(d: Dialect, days: str) -> str:
    """The last day's struct after all ``days``, an array of day structs in order."""
    return d.fold(days, fwi_first(d), "s", "y", fwi_step(d, "s", "y"))
