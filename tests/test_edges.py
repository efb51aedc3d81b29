"""Rows that lie on an edge: ties, exponents, long bodies, and crowds, each against the SQL or the plain way."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headcast.functions.scores import NORMAL, Z80
from headcast.operators import arrivals, features, joins, online, sinks, sliding
from headcast.operators import calibration as cal
from headcast.plans import registry
from headcast.streaming import jobs, stateful
from headcast.streaming.replay import as_stream, run_through

T0 = datetime(2026, 1, 1, 8)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def test_departure_seconds_below_a_thousandth(spark):
    """Numbers in the snapshot's text are written as SQL writes them."""
    values = [0.0, 1e-3, 9.5e-4, 5e-4, 1.9621849060058594e-4, 1e-4, 9.5e-5, 5e-5, 9.5367431640625e-07, 12.0, 10800.0]
    want = [duckdb.execute("SELECT CAST(?::DOUBLE AS VARCHAR)", [v]).fetchone()[0] for v in values]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", features.plain_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == want
    asked = spark.createDataFrame([(1, "Red", 1, at(100))], "request_id long, line string, board long, at timestamp_ntz")
    seen = spark.createDataFrame([("Red", 1, at(90), at(100.0002), True, 'a"arrives_s":"1"', False, 1)], "line string, station long, polled_at timestamp_ntz, arrival_at timestamp_ntz, approaching boolean, run string, fault boolean, event_id long")
    (row,) = features.departure_snapshot(asked, seen, 60.0, 60.0).collect()
    (gone,) = json.loads(row.live_departures)
    assert row.live_departures.startswith('[{"arrives_s":0.000') and gone["run"] == 'a"arrives_s":"1"' and gone["arrives_s"] == pytest.approx(2e-4, abs=1e-6)


def test_histogram_of_actuals_on_edges(spark):
    """Actuals at p80 and as far below the median lie on edges of bins; each goes where the SQL's logarithms put it."""
    rows = [(f"l{p50}:{share}", float(p50), p50 * 1.25, p50 * share) for p50 in range(300, 1270, 10) for share in (0.8, 1.0, 1.25)]
    frame = spark.createDataFrame(rows, "line string, p50 double, p80 double, actual double")
    got = {r.line: r.bin for r in cal.pit_histogram(frame, min_samples=0).where("count = 1").collect()}
    edges = " ".join(f"WHEN (ln(a) - ln(m)) / ((ln(h) - ln(m)) / {Z80!r}::DOUBLE) < {NORMAL.inv_cdf(k / 10)!r}::DOUBLE THEN {k - 1}" for k in range(1, 10))
    want = {n: duckdb.execute(f"SELECT CASE {edges} ELSE 9 END FROM (SELECT ?::DOUBLE AS m, ?::DOUBLE AS h, ?::DOUBLE AS a)", [m, h, a]).fetchone()[0] for n, m, h, a in rows}
    assert got == want


def test_histogram_pooled_over_edges(spark):
    """All lines together, with actuals that fit no logarithm."""
    rows = [(float(p50), p50 * 1.25, p50 * share) for p50 in range(300, 1270, 10) for share in (0.8, 1.25)] + [(300.0, 375.0, 0.0), (300.0, 300.0, 310.0)]
    z = lambda m, h, a: (math.log(a) - math.log(m)) / ((math.log(h) - math.log(m)) / Z80)
    want = [0] * 10
    for m, h, a in rows[:-2]:
        want[sum(z(m, h, a) >= NORMAL.inv_cdf(k / 10) for k in range(1, 10))] += 1
    want[0] += 1
    want[9] += 1
    got = cal.pit_histogram(spark.createDataFrame(rows, "p50 double, p80 double, actual double").withColumn("line", F.lit("x")), pooled=True).collect()
    assert [r["count"] for r in sorted(got, key=lambda r: r.bin)] == want


def test_long_bodies_in_base64_have_no_line_breaks(spark):
    bodies = [b"x" * n for n in (0, 1, 57, 58, 1000)]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary")
    got = [r.t for r in sorted(frame.select("i", sinks.body_text(F.col("b"), F.lit("application/octet-stream")).alias("t")).collect())]
    assert got == [duckdb.execute("SELECT 'BASE64:' || base64(?::BLOB)", [b]).fetchone()[0] for b in bodies]


class Kept:
    """A list in the state, and how often it was read."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    appendList = lambda self, rows: self.rows.extend(rows)
    clear = lambda self: self.rows.clear()


class Handle:
    def __init__(self):
        self.timers, self.lists = set(), {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, Kept())

    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.discard(at)
    listTimers = lambda self: iter(sorted(self.timers))


class Clock:
    def __init__(self, now):
        self.now = now

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.now


def test_a_crowd_of_forecasts_is_settled_with_one_look(spark):
    """Lists of a key are read once a batch, however many forecasts are due; the rest waits for its own time."""
    handle, work = Handle(), stateful.SettleForecasts(300)
    work.init(handle)
    second = stateful.SECOND
    asked = [("forecast", i, i * second, (i + 50) * second) for i in range(500)]
    came = [("arrival", stateful.NONE, i * second, stateful.NONE) for i in range(7, 400, 7)]
    list(work.handleInputRows(("Red", 1), iter([pd.DataFrame(asked + came, columns=list(stateful.QUESTION))]), Clock(0)))
    assert len(handle.timers) == 1
    out = []
    for now in (600_000, 2_000_000):
        while handle.timers and min(handle.timers) <= now:
            handle.timers.discard(min(handle.timers))
            out += [r for part in work.handleExpiredTimer(("Red", 1), Clock(now), Clock(now)) for r in part.itertuples(index=False)]
    assert handle.lists["pending"].reads == 2 and not handle.lists["pending"].rows
    first = {i: next((a for _, _, a, _ in came if a >= i * second), None) for i in range(500)}
    assert {r.request_id: (r.status, r.settled_us, r.wait_us) for r in out} == {
        i: ("unresolvable", (i + 350) * second, None) if a is None or a > (i + 350) * second else ("resolved", max((i + 50) * second, a), a - i * second) for i, a in first.items()
    }


def test_interval_join_meets_stretches(spark):
    """Pairs across borders of stretches, unmet forecasts once, and state buckets of a stretch rather than a key's history."""
    left = [(i, "a", at(i * 3000)) for i in range(60)] + [(100, "b", at(10))]
    right = [(i, "a", at(i * 7200)) for i in range(22)] + [(200, "a", at(500_000)), (201, "b", at(500_000))]
    asked, came = spark.createDataFrame(left, "request_id long, key string, leave_at timestamp"), spark.createDataFrame(right, "event_id long, a_key string, arrived_at timestamp")
    late = spark.createDataFrame([(999, "z", at(500_000))], "request_id long, key string, leave_at timestamp")
    streams = as_stream(asked.unionByName(late), F.when(F.col("request_id") == 999, 1).otherwise(0)), as_stream(came, F.when(F.col("event_id") >= 200, 1).otherwise(0))
    joined = jobs.interval_join(*streams, "2 hours", "1 hour")
    assert joined.columns == [*asked.columns, *came.columns] and "__a_bin" in joined._jdf.queryExecution().analyzed().toString()
    got = sorted((r.request_id, -1 if r.event_id is None else r.event_id) for r in run_through(joined).rows.where("request_id < 999").collect())
    pairs = [(i, e) for i, k, t in left for e, a, u in right if k == a and 0 <= (u - t).total_seconds() <= 7200]
    assert got == sorted(pairs + [(i, -1) for i, _, _ in left if i not in {p[0] for p in pairs}])


def test_pooled_histogram_of_tables_on_edges(spark, tmp_path):
    """The registered query against its own SQL, on orders whose items put actuals at p80 and 0.8 of the median."""
    keys = [k for k in range(600) if k % 10 > 1]
    orders = spark.createDataFrame([(k, k % 7, "O", "1-URGENT", datetime(1996, 1, 1)) for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz")
    share = lambda k: 1.25 if k % 2 else 0.8
    items = [(k, ((300.0 + 10 * (k % 97)) * share(k) - 200) / 20, datetime(1996, 2, 1)) for k in keys for _ in range(2)]
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.queries()["g7_pit_pooled"](spark, str(tmp_path)).collect()
    assert sorted((r.line, r.bin, r["count"], r.density) for r in got) == sorted(con.execute(registry.oracle_sql()["g7_pit_pooled"]).fetchall())


def test_replay_computes_its_table_once(spark):
    """A replayed table is computed once, whatever the number of batches, and each batch comes in its turn."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(40).mapInArrow(counted, "id long").withColumn("b", F.when(F.col("id") != 7, F.col("id") % 4))
    rows = run_through(as_stream(frame, F.col("b")), "append").rows
    assert sorted((r.id, r.batch) for r in rows.collect()) == [(i, i % 4) for i in range(40) if i != 7] and seen.value == 40


def test_conformal_by_the_batch_equals_row_by_row():
    """What was a loop over the step sizes, to the last bit; rows of a batch count in order, unknown times first."""

    def plain(rows, target, remember):
        offset, size, missed, weights = 0.0, 0.0, 0, [0.0] * 4
        for raw, seen in rows:
            weights = weights if remember else [0.0] * 4
            covered = 1.0 if seen <= max(0.0, raw + offset) else 0.0
            missed, miss = missed + int(1 - covered), target - covered
            for i, s in enumerate(online.STEPS):
                error = seen - raw - (offset + s * miss)
                weights[i] -= online.ETA * max(target * error, (target - 1) * error)
            weights = [w - max(weights) for w in weights]
            mass = [math.exp(w) for w in weights]
            size = sum(m * s for m, s in zip(mass, online.STEPS)) / sum(mass)
            offset = max(-online.BOUND, min(online.BOUND, offset + size * miss))
        return offset, size, len(rows), missed, weights

    draw = random.Random(8)
    rows = [(draw.uniform(0, 900), draw.uniform(0, 1500)) for _ in range(2000)] + [(5.0, 5.0), (0.0, 0.0), (1e5, 0.0), (0.0, 1e5)]
    for target, remember in ((0.8, False), (0.9, True)):
        fold = online.Conformal(target, remember)
        fold.update_all(rows[:700])
        for r in rows[700:]:
            fold.update(*r)
        assert (fold.offset, fold.step_size, fold.n, fold.missed, fold.weights) == plain(rows, target, remember)


def test_trips_are_dealt_over_tasks_by_their_number(spark):
    """More rows make more tasks rather than larger ones, with the same trips."""
    draw = random.Random(9)
    asked = spark.createDataFrame([(i, draw.choice("ab"), draw.randrange(4), draw.randrange(4), at(draw.randrange(3000))) for i in range(120)], "request_id int, line string, board int, alight int, leave_at timestamp_ntz")
    seen = spark.createDataFrame([(draw.choice("ab"), draw.randrange(3), draw.randrange(4), at(draw.randrange(4000))) for _ in range(200)], "line string, run int, station int, observed_at timestamp_ntz").distinct()
    few, many = (arrivals.resolve_trips(asked, seen, 3600.0, task_rows=n) for n in (500_000, 20))
    assert many.rdd.getNumPartitions() > 30 > few.rdd.getNumPartitions() and sorted(few.collect()) == sorted(many.collect())


@pytest.mark.parametrize("name", ["j11_nearest", "j16_observations", "f15_live_features", "f16_departure_snapshots"])
def test_no_pairs_of_requests_and_rows(spark, sf, name):
    """Windows slide along sorted rows; nothing is joined by bins of time, whose pairs grow with the square of the density."""
    assert "__rbin" not in registry.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()


def test_nearest_equals_all_pairs(spark):
    draw = random.Random(5)
    left = [(i, draw.choice("ab"), at(draw.randrange(0, 4000))) for i in range(200)] + [(900, None, at(5)), (901, "c", at(5)), (902, "a", None)]
    right = [(draw.choice("ab"), at(draw.randrange(0, 40) * 100), i, i % 3) for i in range(80)] + [("a", None, 500, 0), (None, at(5), 501, 0)]
    frames = spark.createDataFrame(left, "request_id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, event_id int, run int")
    got = joins.nearest(*frames, ["k"], joins.seconds_of(F.col("t")), joins.seconds_of(F.col("u")), 60.0, "event_id")
    want = {}
    for i, k, t in left:
        near = [(abs((u - t).total_seconds()), e, r) for key, u, e, r in right if k is not None and k == key and t and u and abs((u - t).total_seconds()) <= 60]
        if near:
            want[i] = min(near)
    assert {r.request_id: (r.nearest.gap_s, r.nearest.event_id, r.nearest.run) for r in got.collect()} == want


def test_windows_of_sightings_marks_and_means(spark):
    draw = random.Random(6)
    right = [("a", at(draw.randrange(0, 900)), draw.choice([None, 1, 2, 3]), draw.random() < 0.5, draw.random() < 0.3, draw.choice([None, 0.1, 1e9, -1e9, 0.7])) for _ in range(150)]
    left = [(i, "a", at(i * 30)) for i in range(30)]
    rows = spark.createDataFrame(right, "k string, u timestamp_ntz, v int, m1 boolean, m2 boolean, x double")
    asked = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    over = lambda make, values: {r.i: tuple(r)[3:] for r in sliding.over_windows(asked, rows, ["k"], sliding.micros(F.col("t")), sliding.micros(F.col("u")), -100_000_000, 50_000_000, make, values).collect()}
    seen, marked, means = over(sliding.Sightings, ["v"]), over(sliding.Marks, ["m1", "m2", "v"]), over(sliding.Mean, ["x"])
    for i, _, t in left:
        inside = [r for r in right if -100 <= (r[1] - t).total_seconds() <= 50]
        different = len({r[2] for r in inside} - {None})
        assert seen[i][:2] == (len(inside), different) and marked[i] == (sum(r[3] for r in inside), sum(r[4] for r in inside), different)
        known = [r[5] for r in inside if r[5] is not None]
        assert means[i][0] == len(known) and (not known or means[i][1] == pytest.approx(math.fsum(known) / len(known), abs=1e-6))


def test_vehicle_links_in_blocks(spark):
    """Blocks of a few pairs give what all pairs give, and no pair is a row of the plan."""
    draw = random.Random(7)
    left = [("a", draw.randrange(3), 41.8 + draw.randrange(50) / 1000, -87.6, at(draw.randrange(3000))) for _ in range(60)] + [(None, 1, 41.8, -87.6, at(1)), ("b", 1, None, -87.6, at(1))]
    right = [("a", f"v{draw.randrange(4)}", 41.8 + draw.randrange(50) / 1000, -87.6, at(draw.randrange(3000))) for _ in range(60)] + [("b", "v1", 41.8, -87.6, None)]
    frames = spark.createDataFrame(left, "line string, run long, lat double, lon double, at timestamp_ntz"), spark.createDataFrame(right, "line string, vehicle string, lat2 double, lon2 double, at2 timestamp_ntz")
    got = arrivals.link_vehicles(*frames, 2000.0, 90.0, 1, block=7)
    assert "__rbin" not in got._jdf.queryExecution().analyzed().toString()
    want: dict = {}
    for line, run, y, _, t in left[:-2]:
        for other, vehicle, y2, _, u in right[:-1]:
            d = math.radians(abs(y2 - y)) * 6_371_000
            if line == other and abs((u - t).total_seconds()) <= 90 and d <= 2000:
                want.setdefault((line, run, vehicle), []).append(d)
    rows = {(r.line, r.run, r.vehicle): (r.n, r.mean_m, r.max_m) for r in got.collect()}
    assert rows.keys() == want.keys()
    for key, ds in want.items():
        assert rows[key] == (len(ds), pytest.approx(sum(ds) / len(ds), abs=1e-3), pytest.approx(max(ds), abs=1e-3))
