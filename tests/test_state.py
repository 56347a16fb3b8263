"""Streams with typed state: codes carried over batches, late days, and clusters that change their ids."""

import random

import pandas as pd
import pytest

from cinderlake.operators import cluster, weather
from cinderlake.streaming import detections as live
from cinderlake.streaming import rekey, state

DAY = "site long, day long, temperature_c double, humidity_pct double, wind_kmh double, day_rain double, month int, latitude double"
CODES = ("ffmc", "dmc", "dc", "isi", "bui", "fwi")


def test_published_day():
    ffmc, dmc, dc = state.fine_fuel(85, 17, 42, 25, 0), state.duff(6, 17, 42, 0, 12.8), state.drought(15, 17, 0, 0.9)
    assert [ffmc, dmc, dc, *state.indices(ffmc, dmc, dc, 25)] == pytest.approx([87.69, 8.55, 19.01, 10.85, 8.49, 10.10], abs=0.01)


def days(n, seed=1):
    r = random.Random(seed)
    return [(site, d, r.uniform(-5, 40), r.uniform(5, 110), r.uniform(0, 60), r.choice([0.0, 0.4, 1.6, 3.0, 40.0]), r.randint(1, 12), r.choice([38.0, -30.0, 10.0, 60.0])) for site in (1, 2, 3) for d in range(n)]


def run(spark, batches, path):
    for rows in batches:
        spark.createDataFrame(rows, DAY).coalesce(1).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(DAY).option("maxFilesPerTrigger", 1).parquet(path)
    return live.drain(state.carried_codes(arriving)).collect()


def test_codes_carried_over_batches_are_those_of_the_whole_series(spark, tmp_path):
    rows = days(24)
    got = run(spark, [[r for r in rows if r[1] < 9], [r for r in rows if 9 <= r[1] < 15] + rows[:3], [r for r in rows if r[1] >= 15]], str(tmp_path / "in"))
    assert len(got) == len(rows)  # the repeated days come too late and add nothing
    fold = {r["site"]: r for r in weather.fire_weather(spark.createDataFrame(rows, DAY)).collect()}
    last = {r["site"]: r for r in got if r["day"] == 23}
    for site in (1, 2, 3):
        assert [last[site][c] for c in CODES] == pytest.approx([fold[site][c] for c in CODES], abs=0.011) and last[site]["n_days"] == 24


def test_late_detections_join_incidents_and_move_their_ids(spark):
    known = spark.createDataFrame([], rekey.MEMBER)
    hour = 3_600_000_000
    first = [(10, 50 * hour, 38.0, 23.0), (11, 51 * hour, 38.01, 23.0), (20, 50 * hour, 38.0, 23.1), (21, 52 * hour, 38.01, 23.1), (30, 50 * hour, 39.0, 25.0)]
    point = "id long, us long, latitude double, longitude double"
    before = rekey.absorb(known, spark.createDataFrame(first, point), 0)
    assert {r["id"]: r["cluster"] for r in before.collect()} == {10: 10, 11: 10, 20: 20, 21: 20, 30: -1}
    # Between the two, earlier than both, and one that meets the lone one; a repeated id stays as it was.
    late = [(5, 40 * hour, 38.0, 23.03), (6, 45 * hour, 38.0, 23.06), (7, 48 * hour, 38.0, 23.08), (31, 60 * hour, 39.01, 25.0), (10, 0, 0.0, 0.0)]
    after = rekey.absorb(before, spark.createDataFrame(late, point), 0)
    assert {r["id"]: r["cluster"] for r in after.collect()} == {**dict.fromkeys((5, 6, 7, 10, 11, 20, 21), 5), 30: 30, 31: 30}
    ids = {r["cluster"]: r["incident_id"] for r in rekey.incident_ids(before).collect()}
    new = {r["cluster"]: r["incident_id"] for r in rekey.incident_ids(after).collect()}
    assert sorted(map(tuple, rekey.renamed(before, after).collect())) == sorted([(ids[10], new[5]), (ids[20], new[5])])
    # The link leaves the window: the incident falls apart again.
    later = rekey.absorb(after, spark.createDataFrame([], point), 49 * hour)
    assert {r["id"]: r["cluster"] for r in later.collect()} == {10: 10, 11: 10, 20: 20, 21: 20, 30: 30, 31: 30}
    assert {tuple(r) for r in rekey.renamed(after, later).collect()} == {(new[5], ids[10]), (new[5], ids[20])}


def test_any_cut_into_batches_gives_the_clusters_of_all(spark):
    r = random.Random(9)
    hour = 3_600_000_000
    points = [(i, int(r.uniform(0, 120) * hour), r.uniform(37.8, 38.1), r.uniform(22.8, 23.1)) for i in range(90)]
    schema = "id long, us long, latitude double, longitude double"
    known = spark.createDataFrame([], rekey.MEMBER)
    r.shuffle(points)
    for i in range(0, 90, 30):
        oldest = max(p[1] for p in points[: i + 30]) - 72 * hour
        known = rekey.absorb(known, spark.createDataFrame(points[i : i + 30], schema), oldest)
    whole = spark.createDataFrame([p for p in points if p[1] >= oldest], schema)
    want = {x["id"]: x["cluster"] for x in cluster.placed_clusters(rekey.placed(whole).select("id", "x", "y", "h")).collect()}
    assert {x["id"]: x["cluster"] for x in known.collect()} == want


class Held:
    """A group's state as the functions see it."""

    def __init__(self):
        self.get, self.timer, self.now, self.hasTimedOut = None, None, 0, False

    @property
    def exists(self):
        return self.get is not None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at >= self.now
        self.timer = at

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = self.timer = None


def test_one_group_keeps_a_timer_for_each_of_its_users():
    hour = 3_600_000
    held, rows = Held(), []

    def call(now, *came):
        held.now, held.hasTimedOut = now * hour, not came
        for out in state.fall_quiet((0,), iter([pd.DataFrame({"user_id": [u for u, _ in came], "us": [h * hour * 1000 for _, h in came]})]), held):
            rows.extend(out.itertuples(index=False, name=None))

    call(0, (1, 10), (2, 30), (1, 8))
    assert held.timer == 22 * hour
    call(30, (2, 31))  # the group has data, and user 1 is due beside it
    assert rows == [(1, 10 * hour * 1000, 2, "contained")] and held.timer == 43 * hour
    call(60)
    assert sorted(rows[1:]) == [(1, 10 * hour * 1000, 2, "out"), (2, 31 * hour * 1000, 2, "contained")]
    call(90)
    assert rows[3:] == [(2, 31 * hour * 1000, 2, "out")] and held.get is None


def test_one_group_carries_the_codes_of_many_sites_and_forgets_each_by_itself():
    held = Held()
    columns = [c.split()[0] for c in DAY.split(", ")]
    together = {r[:2]: r for out in state.carry((0,), iter([pd.DataFrame(days(6), columns=columns)]), held) for r in out.itertuples(index=False, name=None)}
    for site in (1, 2, 3):
        alone = next(state.carry((0,), iter([pd.DataFrame([r for r in days(6) if r[0] == site], columns=columns)]), Held()))
        assert [together[site, d] for d in range(6)] == [*alone.itertuples(index=False, name=None)]
    held.now = (6 + state.CODES_TTL_DAYS) * state.DAY_MS + 1
    assert [len(out) for out in state.carry((0,), iter([pd.DataFrame([(2, 97, 20.0, 40.0, 10.0, 0.0, 7, 38.0)], columns=columns)]), held)] == [1]
    assert held.get[0] == [2] and held.get[3] == [7]


def test_users_far_apart_and_without_a_number_fall_quiet(spark, tmp_path):
    path = str(tmp_path / "in")
    users = [None, -1, 0, 255, 256, 10**15]
    for days_in in (0, 5, 10):
        rows = [(u, 1_704_067_200 + days_in * 86_400 + i) for i, u in enumerate([7] if days_in else users)]
        live.deal(spark.createDataFrame(rows, "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS at"), path, 3)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 9  # each deal has all its files, few rows or none
    schema = spark.sql("SELECT 0L AS user_id, current_timestamp() AS at").schema
    got = live.drain(state.quiet_fires(live.dealt(spark, schema, path, 3).withWatermark("at", "0 seconds"))).collect()
    assert sorted(map(str, ((r["user_id"], r["status"], r["n"]) for r in got))) == sorted(str((u, s, 1)) for u in users for s in ("contained", "out"))


def test_a_deal_is_one_batch_in_many_files(spark, tmp_path):
    path, sizes = str(tmp_path / "in"), []
    rows = [spark.range(a, b).selectExpr("id", "if(id % 3 = 0, NULL, id) AS x") for a, b in ((0, 1000), (1000, 1002), (1002, 1300))]
    for part in rows:
        live.deal(part, path, 4)
    arriving = live.dealt(spark, rows[0].schema, path, 4)
    arriving.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [1000, 2, 298]
