"""Streams that keep typed state for each key: fire-weather codes carried from day to day, and fires that fall quiet.

A query's checkpoint holds the state, so a stream that stops goes on where it was. State that is no longer asked for goes by timeouts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinderlake import dims
from cinderlake.functions import formulas as f
from cinderlake.shipping import ship

#: A site that has sent nothing for so many days, as all sites' days go on, is forgotten and starts anew, as its drought is then no longer known.
CODES_TTL_DAYS = 90
DAY_MS = 86_400_000


def rounded(x: float, digits: int = 2) -> float:
    """Half up, as ``formulas.rnd`` has it."""
    scale = 10.0**digits
    return math.floor(x * scale + 0.5 + 1e-7) / scale


def fine_fuel(before: float, t: float, rh: float, wind: float, rain: float) -> float:
    """The fine fuel moisture code after a day: rain wets, then the fuel dries or wets towards its equilibrium."""
    rh = min(rh, 100.0)
    moisture = 147.2 * (101.0 - before) / (59.5 + before)
    if rain > 0.5:
        fallen = rain - 0.5
        wetter = moisture + 42.5 * fallen * math.exp(-100.0 / (251.0 - moisture)) * (1.0 - math.exp(-6.93 / fallen))
        if wetter > 150.0:
            wetter += 0.0015 * (wetter - 150.0) ** 2 * math.sqrt(fallen)
        moisture = wetter
    moisture = min(moisture, 250.0)
    heat = 0.18 * (21.1 - t) * (1.0 - math.exp(-0.115 * rh))
    steep = math.exp((rh - 100.0) / 10.0)
    drying_to = 0.942 * rh**0.679 + 11.0 * steep + heat
    wetting_to = 0.618 * rh**0.753 + 10.0 * steep + heat
    for limit, humid, towards in ((drying_to, rh / 100.0, moisture > drying_to), (wetting_to, (100.0 - rh) / 100.0, moisture < wetting_to)):
        if towards:
            speed = (0.424 * (1.0 - humid**1.7) + 0.0694 * math.sqrt(wind) * (1.0 - humid**8)) * 0.581 * math.exp(0.0365 * t)
            moisture = limit + (moisture - limit) * 10.0**-speed
            break
    return min(max(59.5 * (250.0 - moisture) / (147.2 + moisture), 0.0), 101.0)


def duff(before: float, t: float, rh: float, rain: float, day: float) -> float:
    """The duff moisture code after a day."""
    code = max(before, 1e-9)
    if rain > 1.5:
        slope = 100.0 / (0.5 + 0.3 * code) if code <= 33.0 else 14.0 - 1.3 * math.log(code) if code <= 65.0 else 6.2 * math.log(code) - 17.2
        through = 0.92 * rain - 1.27
        moisture = 20.0 + math.exp(5.6348 - code / 43.43) + 1000.0 * through / (48.77 + slope * through)
        code = max(0.0, 244.72 - 43.43 * math.log(max(moisture - 20.0, 1e-9)))
    return max(0.0, code + 100.0 * 1.894 * (max(t, -1.1) + 1.1) * (100.0 - min(rh, 100.0)) * day * 1e-6)


def drought(before: float, t: float, rain: float, day: float) -> float:
    """The drought code after a day."""
    code = before
    if rain > 2.8:
        left = 800.0 * math.exp(-code / 400.0) + 3.937 * (0.83 * rain - 1.27)
        code = max(0.0, 400.0 * math.log(800.0 / max(left, 1e-9)))
    return max(0.0, code + 0.5 * max(0.0, 0.36 * (max(t, -2.8) + 2.8) + day))


def indices(ffmc: float, dmc: float, dc: float, wind: float) -> tuple[float, float, float]:
    """Initial spread, build-up and fire weather index."""
    moisture = 147.2 * (101.0 - ffmc) / (59.5 + ffmc)
    isi = 0.208 * math.exp(0.05039 * wind) * 91.9 * math.exp(-0.1386 * moisture) * (1.0 + moisture**5.31 / 4.93e7)
    if dmc <= 0 and dc <= 0:
        bui = 0.0
    elif dmc <= 0.4 * dc:
        bui = 0.8 * dmc * dc / (dmc + 0.4 * dc)
    else:
        bui = max(0.0, dmc - (1.0 - 0.8 * dc / (dmc + 0.4 * dc)) * (0.92 + (0.0114 * dmc) ** 1.7))
    by_buildup = 0.626 * bui**0.809 + 2.0 if bui <= 80.0 else 1000.0 / (25.0 + 108.64 * math.exp(-0.023 * bui))
    raw = 0.1 * isi * by_buildup
    return isi, bui, max(0.0, raw) if raw <= 1.0 else math.exp(2.72 * (0.434 * math.log(raw)) ** 0.647)


def day_length(high: tuple[float, ...], low: tuple[float, ...], month: int, latitude: float) -> float:
    share = min(max((abs(latitude) - 20.0) / 26.0, 0.0), 1.0)
    return low[month - 1] + (high[month - 1] - low[month - 1]) * share


CODES = "site long, day long, n_days long, ffmc double, dmc double, dc double, isi double, bui double, fwi double"

#: Neighbouring keys whose state one group holds: what a call of Python costs is shared, and a group stays some kilobytes.
KEYS_AT_ONCE = 256
CODES_STATE = "site array<long>, due array<long>, day array<long>, n_days array<long>, ffmc array<double>, dmc array<double>, dc array<double>"


def group_of(key: str) -> str:
    return f"{key} div {KEYS_AT_ONCE} AS keys"


def held(state: GroupState) -> dict:
    """What the group holds for each of its keys: when it is due, and its values."""
    return {k: v for k, *v in zip(*state.get, strict=True)} if state.exists else {}


def hold(state: GroupState, keys: dict) -> None:
    """Keeps the keys; the group's timer is that of the key due first. Without keys its state goes."""
    if not keys:
        state.remove()
        return
    state.update(tuple(map(list, zip(*((k, *v) for k, v in keys.items()), strict=True))))
    state.setTimeoutTimestamp(min(v[0] for v in keys.values()))


def overdue(keys: dict, came: set, now: int) -> list:
    """Keys whose own timer has run out and for which nothing came, as Spark has it for a key in a group of its own."""
    return [k for k, v in keys.items() if v[0] < now and k not in came]


def carry(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Codes of the sites of a group after each new day, carried rounded. Days at or before the last one carried come too late and are left out, repeats too."""
    now = state.getCurrentWatermarkMs()
    sites, came, out = held(state), set(), []
    if not state.hasTimedOut:
        for d in pd.concat(list(batches)).sort_values(["site", "day"], kind="stable").itertuples():
            site = None if pd.isna(key[0]) else int(d.site)
            came.add(site)
            _, last, n, *codes = sites.get(site, (0, None, 0, *f.FWI_START))
            if last is not None and d.day <= last:
                continue
            ffmc = fine_fuel(codes[0], d.temperature_c, d.humidity_pct, d.wind_kmh, d.day_rain)
            dmc = duff(codes[1], d.temperature_c, d.humidity_pct, d.day_rain, day_length(f.DMC_DAY_46, f.DMC_DAY_20, d.month, d.latitude))
            dc = drought(codes[2], d.temperature_c, d.day_rain, day_length(f.DC_DAY_46, f.DC_DAY_20, d.month, d.latitude))
            codes, last, n = [rounded(ffmc), rounded(dmc), rounded(dc)], int(d.day), n + 1
            out.append((site, last, n, *codes, *map(rounded, indices(ffmc, dmc, dc, d.wind_kmh))))
            sites[site] = [0, last, n, *codes]
        for site in came:
            sites[site] = [max(now + 1, (sites[site][1] + 1 + CODES_TTL_DAYS) * DAY_MS), *sites[site][1:]]
    for site in overdue(sites, came, now):
        del sites[site]
    hold(state, sites)
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CODES.split(", ")])


def carried_codes(daily: DataFrame) -> DataFrame:
    """From a stream of days (site, day, temperature_c, humidity_pct, wind_kmh, day_rain, month, latitude): each day's codes and indices."""
    ship(daily.sparkSession)
    timed = daily.selectExpr(group_of("site"), "site", "day", "temperature_c", "humidity_pct", "wind_kmh", "day_rain", "month", "latitude", "timestamp_seconds((day + 1) * 86400) AS at").withWatermark("at", "30 days")
    return timed.groupBy("keys").applyInPandasWithState(carry, CODES, CODES_STATE, "append", GroupStateTimeout.EventTimeTimeout)


QUIET = "user_id long, last_us long, n long, status string"
CONTAINED_MS, OUT_MS = int(dims.QUIET_CONTAINED_H * 3_600_000), int(dims.QUIET_OUT_H * 3_600_000)


QUIET_STATE = "user_id array<long>, due array<long>, last_us array<long>, n array<long>, told array<int>"


def fall_quiet(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fires of a group's users that fall quiet: contained after the shorter silence, out after the longer one, when they are forgotten. What comes later is a new fire."""
    now = state.getCurrentWatermarkMs()
    fires, came, out = held(state), set(), []
    if not state.hasTimedOut:
        times = pd.concat(list(batches)).groupby("user_id", dropna=False)["us"].agg(["max", "size"])
        for newest in times.itertuples():
            user = None if pd.isna(key[0]) else int(newest.Index)
            came.add(user)
            _, before, n, _ = fires.get(user, (0, 0, 0, 0))
            last = max(int(newest.max), before)
            fires[user] = [max(now + 1, last // 1000 + CONTAINED_MS), last, n + int(newest.size), 0]
    for user in overdue(fires, came, now):
        _, last, n, told = fires[user]
        found = ["contained"] * (not told) + ["out"] * (now >= last // 1000 + OUT_MS)
        out += [(user, last, n, status) for status in found]
        if "out" in found:
            del fires[user]
        else:
            fires[user] = [max(now + 1, last // 1000 + OUT_MS), last, n, 1]
    hold(state, fires)
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUIET.split(", ")])


def quiet_fires(events: DataFrame) -> DataFrame:
    """From a stream of events (user_id, at with a watermark): a row whenever a user's fire is found contained or out."""
    ship(events.sparkSession)
    timed = events.selectExpr(group_of("user_id"), "user_id", "at", "unix_micros(at) AS us")
    return timed.groupBy("keys").applyInPandasWithState(fall_quiet, QUIET, QUIET_STATE, "append", GroupStateTimeout.EventTimeTimeout)
