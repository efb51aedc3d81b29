"""Keyed state, late rows, restarts and the log tail, on small streams."""

from __future__ import annotations

import datetime as dt
import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from headcast.operators import online
from headcast.plans import streams
from headcast.sources import tail
from headcast.streaming import jobs, stateful
from headcast.streaming.replay import as_stream, newest, run_through

DAY = dt.datetime(2024, 3, 1)
SAMPLES = "line string, run long, station long, polled_at timestamp_ntz, arrival_at timestamp_ntz, approaching boolean, fault boolean, direction_code string, b int"


def at(minutes: float) -> dt.datetime:
    return DAY + dt.timedelta(minutes=minutes)


def test_a_stay_is_given_out_once_and_late_rows_are_dropped(spark):
    told = [
        ("A", 1, 7, at(0), at(20), False, False, "n", 0), ("A", 1, 7, at(10), at(21), False, False, None, 1), ("A", 1, 7, at(5), at(24), False, True, "n", 1),
        ("A", 2, 7, at(0), at(30), False, False, "s", 0), ("A", 2, 7, at(300), at(310), True, False, "s", 1), ("A", 9, 9, at(3000), at(3001), False, False, "", 2), ("A", 9, 9, at(9000), None, None, False, "", 3),
        # behind the watermark of batch 2 when it comes
        ("A", 1, 7, at(12), at(13), True, False, "late", 3), (None, 1, 7, at(12), at(13), True, False, "n", 0),
    ]
    seen = [("A", 1, 7, at(19), True, "w", 1), ("A", 3, None, at(19), True, "w", 1)]
    arrivals = as_stream(spark.createDataFrame(told, SAMPLES), F.col("b"))
    positions = as_stream(spark.createDataFrame(seen, "line string, run long, station long, polled_at timestamp_ntz, approaching boolean, direction_code string, b int"), F.col("b"))
    ran = run_through(stateful.settled_arrivals(arrivals, positions, horizon_s=3600, late="30 minutes"))
    minutes = lambda us: (us / 1e6 - DAY.replace(tzinfo=dt.timezone.utc).timestamp()) / 60
    got = sorted((r.run, minutes(r.observed_us), r.inferred_from, r.direction_code, r.sample_count) for r in ran.rows.collect())
    assert got == [(1, 19.0, "positions:approaching", "w", 3), (2, 30.0, "arrivals:dropoff", "s", 1), (2, 310.0, "arrivals:approaching", "s", 1), (9, 3001.0, "arrivals:dropoff", None, 1)]
    assert ran.dropped == 1 and ran.batches >= 4


def test_forecasts_time_out_and_a_restart_goes_on(spark, tmp_path):
    asked = [(i, "A", i % 2, at(10 * i), at(10 * i + 15), i // 10) for i in range(40)]
    came = [(100 + i, "A", 0, at(25 * i + 3), i // 4) for i in range(16)]
    left = spark.createDataFrame(asked, "request_id long, line string, station long, leave_at timestamp_ntz, resolve_after timestamp_ntz, b int")
    right = spark.createDataFrame(came, "event_id long, line string, station long, arrived_at timestamp_ntz, b int")
    where = {"checkpoint": f"{tmp_path}/state", "out": f"{tmp_path}/out"}
    forecasts, arrivals = as_stream(left, F.col("b")), as_stream(right, F.col("b"))
    run_through(stateful.settled_forecasts(forecasts, arrivals, 300, "20 minutes"), **where)
    rows = run_through(stateful.settled_forecasts(forecasts, arrivals, 300, "20 minutes"), **where).rows.collect()
    want = {}
    for i, _, station, leave, due, _ in asked:
        first = min((a for _, _, s, a, _ in came if s == station and leave <= a <= due + dt.timedelta(minutes=5)), default=None)
        if due + dt.timedelta(minutes=5) <= at(390 - 20):
            want[i] = ("unresolvable", None) if first is None else ("resolved", int((first - leave).total_seconds() * 1e6))
    assert {r.request_id: (r.status, r.wait_us) for r in rows} == want and len(rows) == len(want)
    assert {s for s, _ in want.values()} == {"resolved", "unresolvable"}


def test_kept_folds_equal_the_batch_and_start_from_given_states(spark):
    rng = random.Random(4)
    rows = [(f"c{k % 3}", DAY.date() + dt.timedelta(days=k), rng.choice("abc"), rng.random(), 0.5 if k % 5 else None, k // 20) for k in range(60)]
    frame = spark.createDataFrame(rows, "corridor_id string, at date, candidate string, score double, incumbent_score double, b int")
    want = {r.corridor_id: tuple(r) for r in online.promotions(frame, "a").collect()}
    kept = newest(run_through(stateful.kept_promotions(as_stream(frame, F.col("b")), "a"), "update").rows, ["corridor_id"])
    assert {r.corridor_id: tuple(r) for r in kept.collect()} == want
    # states of the first two batches given as the start of a new stream
    early = online.promotions(frame.where("b < 2"), "a")
    again = run_through(stateful.kept_promotions(as_stream(frame.where("b = 2"), F.col("b")), "a", initial=early), "update")
    assert {r.corridor_id: tuple(r) for r in newest(again.rows, ["corridor_id"]).collect()} == want


def test_rolling_promotion_adds_a_pair_once(spark):
    rows = [(i, at(60 * 24 * d), 1, 2, True, b) for i, (d, b) in enumerate([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (30, 1)])] + [(50 + i, at(60 * 24 * d), 3, 4, True, 1) for i, d in enumerate((0, 8, 16))] + [(90, at(0), 5, 6, False, 0)] * 3
    asked = as_stream(spark.createDataFrame(rows, "query_id long, queried_at timestamp_ntz, origin long, destination long, success boolean, b int"), F.col("b"))
    got = jobs.rolling_promotions(asked, least=3, late="60 days").collect()
    assert [(r.origin, r.destination, r.n, r.batch) for r in got] == [(1, 2, 3, 0)]


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_log_tail_follows_growth_rotation_and_restart(spark, tmp_path, stretch):
    logs, log = tmp_path / "logs", tmp_path / "logs" / "q.ndjson"
    logs.mkdir()
    line = lambda k: json.dumps({"query_id": f"q{k}", "queried_at": at(k).isoformat(), "success": k % 2 == 0, "boarding_int_id": k, "line": "Grün "}, ensure_ascii=k % 3 == 0) + "\n"

    def imported():
        rows = run_through(tail.query_log(spark, str(logs), stretch=stretch), checkpoint=f"{tmp_path}/state", out=f"{tmp_path}/out").rows.collect()
        assert all(r.alighting_int_id == 0 and r.line == "Grün " and r.success == (r.boarding_int_id % 2 == 0) for r in rows)
        return sorted(r.boarding_int_id for r in rows)

    log.write_text("".join(map(line, range(5))) + "{broken\n[1]\n\n" + line(2) + line(5)[:20])
    assert imported() == list(range(5))
    with log.open("a") as file:
        file.write(line(5)[20:] + line(6))
    (logs / "other.ndjson").write_text(line(3) + line(20))
    assert imported() == [*range(7), 20]
    assert imported() == [*range(7), 20]
    # rotated: shorter, and then longer than before but with another beginning
    log.write_text(line(4) + line(7))
    assert imported() == [*range(8), 20]
    log.write_text("".join(map(line, range(6, 16))))
    assert imported() == [*range(16), 20]


def test_forecasts_meet_arrivals_by_binary_search():
    rng = np.random.default_rng(3)
    asked = np.column_stack([np.arange(40), rng.integers(0, 200, 40) * 1_000_000, np.zeros(40, dtype=np.int64)])
    came = np.column_stack([np.arange(100, 160), rng.integers(0, 200, 60) * 1_000_000])
    frames = list(stateful.MeetForecasts(20, frame_rows=7)._pairs(asked, came))
    want = sorted((i, at, e) for i, at, _ in asked.tolist() for e, then in came.tolist() if at <= then <= at + 20_000_000)
    assert sorted(tuple(r) for f in frames for r in f.itertuples(index=False, name=None)) == want and all(0 < len(f) <= 7 for f in frames)
    assert [i for i, _, met in asked.tolist() if met] == sorted({i for i, _, _ in want})
    assert not list(stateful.MeetForecasts(20)._pairs(asked[:0], came)) and not list(stateful.MeetForecasts(20)._pairs(asked, came[:0]))


def test_forecasts_meet_arrivals_across_stretches_and_batches(spark):
    """Edges of the wait and of stretches, keys that are missing, rows that come late, and forecasts that wait in vain."""
    asked = [(i, "a", at(7 * i), i // 100 if i % 9 else min(i // 100 + 1, 3)) for i in range(400)] + [(500, None, at(10), 0), (501, "a", None, 0), (600, "z", at(9000), 3)]
    came = [(i, "a", at(45 * i), i * 45 // 700 if i % 5 else min(i * 45 // 700 + 1, 3)) for i in range(63)] + [(70, None, at(10), 0), (71, "b", at(10), 0), (72, "z", at(8990), 3)]
    left = spark.createDataFrame(asked, "request_id long, key string, leave_at timestamp, b int")
    right = spark.createDataFrame(came, "event_id long, a_key string, arrived_at timestamp, b int")
    late = "40 hours"
    ran = run_through(stateful.met_forecasts(as_stream(left, F.col("b")), as_stream(right, F.col("b")), 7200, late, stretch=3))
    pairs = [(i, e) for i, k, t, _ in asked for e, a, u, _ in came if t is not None and k is not None and k == a and 0 <= (u - t).total_seconds() <= 7200]
    end = at(8990) - dt.timedelta(hours=40)
    vain = [(i, -1) for i, _, t, _ in asked if t is not None and i not in {p[0] for p in pairs} and t + dt.timedelta(hours=2) < end]
    got = sorted((r.request_id, -1 if r.event_id is None else r.event_id) for r in ran.rows.collect())
    assert got == sorted(pairs + vain) and ran.dropped == 0 and (500, -1) in vain and len(pairs) > 600


def test_registered_interval_join_of_a_busy_stretch(spark, tmp_path, monkeypatch):
    """Many rows of one line and stop within two hours: the rows of the SQL, by a search in a stretch's arrays, with no join that reads a pair at a time."""
    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    spread = [(i, day + dt.timedelta(minutes=20 * i, microseconds=i), rng.randrange(60), rng.choice(["view", "click"]), rng.randrange(100)) for i in range(2160)]
    busy = [(3000 + i, day + dt.timedelta(days=9, seconds=6 * i + 1), 7, "view", 41) for i in range(1200)]
    rows = [(i, t, u, e, 1.0, json.dumps({"k": k})) for i, t, u, e, k in spread + busy]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plans = []
    monkeypatch.setattr(streams, "run_through", lambda stream, *more: (plans.append(stream._jdf.queryExecution().analyzed().toString()), run_through(stream, *more))[1])
    got = sorted(tuple(r) for r in streams.st6_interval_join(spark, str(tmp_path)).select("request_id", "event_id", "leave_at").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT request_id, event_id, leave_at FROM ({streams.JOIN_SQL})").fetchall())
    assert got == want and len(want) > 100_000
    assert len(plans) == 1 and "Join" not in plans[0]
