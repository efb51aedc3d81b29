"""Operators on small hand-made tables: evidence priority, state machines, upserts, payloads, streams."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headcast.functions import geo, scores
from headcast.operators import arrivals, estimate, joins, online, predict, sinks, training
from headcast.operators import calibration as cal
from headcast.sources import ingest
from headcast.streaming import jobs

T0 = datetime(2026, 1, 1, 8)
ARRIVALS = "line string, run long, station long, polled_at timestamp_ntz, arrival_at timestamp_ntz, approaching boolean, fault boolean, direction_code string"
POSITIONS = "line string, run long, station long, polled_at timestamp_ntz, approaching boolean, direction_code string"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def now(seconds: float):
    return F.lit(at(seconds)).cast("timestamp_ntz")


def test_evidence_priority(spark):
    a = spark.createDataFrame(
        [("Red", 1, 1, at(90), at(120), True, False, "1"), ("Red", 2, 1, at(60), at(70), False, False, "1"), ("Red", 3, 1, at(60), at(900), False, False, "1"), ("Red", 4, 1, at(60), at(70), True, None, "1"), ("Red", 1, 1, at(30), at(50), False, False, "")], ARRIVALS
    )
    p = spark.createDataFrame([("Red", 1, 1, at(100), True, "5"), ("Red", 5, 1, at(100), False, "5")], POSITIONS)
    both = {r.run: r for r in arrivals.observed_runs(a, p, now(300)).collect()}
    assert set(both) == {1, 2}
    assert (both[1].observed_at, both[1].inferred_from, both[1].direction_code, both[1].sample_count) == (at(100), "positions:approaching", "5", 3)
    assert (both[2].observed_at, both[2].inferred_from) == (at(70), "arrivals:dropoff")
    alone = {r.run: r for r in arrivals.observed_runs(a, None, now(300)).collect()}
    assert (alone[1].observed_at, alone[1].inferred_from) == (at(120), "approaching")


def test_resolution_takes_the_first_ride_that_arrives(spark):
    asked = spark.createDataFrame([(1, "Red", 10, 20, at(0)), (2, "Red", 10, 99, at(0))], "request_id long, line string, board long, alight long, leave_at timestamp_ntz")
    seen = spark.createDataFrame([("Red", 1, 10, at(60)), ("Red", 2, 10, at(120)), ("Red", 2, 20, at(720)), ("Red", 2, 20, at(800)), ("Red", 1, 20, at(30))], "line string, run long, station long, observed_at timestamp_ntz")
    rows = arrivals.resolve_trips(asked, seen, 3600).collect()
    assert [(r.request_id, r.run, r.wait_s, r.ride_s, r.total_s) for r in rows] == [(1, 2, 120.0, 600.0, 720.0)]
    equal = spark.createDataFrame([("Red", 1, 10, at(60)), ("Red", 1, 20, at(60))], seen.schema)
    assert arrivals.resolve_trips(asked, equal, 3600).count() == 1
    assert arrivals.resolve_trips(asked, equal, 3600, strict=True).count() == 0


def test_band_join_equals_the_plain_condition(spark):
    random.seed(3)
    left = spark.createDataFrame([(i, random.randint(0, 2), random.uniform(0, 1000)) for i in range(60)], "i long, k long, t double")
    right = spark.createDataFrame([(j, random.randint(0, 2), random.uniform(0, 1000)) for j in range(60)], "j long, k long, u double")
    got = joins.band_join(left, right, ["k"], F.col("t"), F.col("u"), -20.0, 35.0)
    want = {(a.i, b.j) for a in left.collect() for b in right.collect() if a.k == b.k and -20 <= b.u - a.t <= 35}
    assert {(r.i, r.j) for r in got.collect()} == want and got.count() == len(want)


def test_spaced_keeps_none_within_the_spacing(spark):
    times = sorted(random.Random(5).sample(range(3000), 200))
    events = spark.createDataFrame([("a", t, t) for t in times], "k string, t long, v long")
    want, last = [], -100
    for t in times:
        if t - last > 30:
            want.append(t)
            last = t
    assert sorted(r.t for r in arrivals.spaced(events, ["k"], "t").collect()) == want


def test_topology_order_and_cycles(spark):
    edges = spark.createDataFrame([("Red", "N", 1, 2, 5), ("Red", "N", 2, 3, 5), ("Red", "N", 1, 3, 5), ("Blue", "N", 8, 9, 5), ("Blue", "N", 9, 8, 5), ("Blue", "N", 1, 8, 5)], "line string, direction_code string, src long, dst long, n long")
    rows = arrivals.topology_order(edges).orderBy("line", "seq").collect()
    assert [(r.line, r.station) for r in rows] == [("Blue", 1), ("Blue", 8), ("Blue", 9), ("Red", 1), ("Red", 2), ("Red", 3)]


def test_crossing_is_interpolated(spark):
    obs = spark.createDataFrame([("v", 1, 10.0, 700.0, 5.0, 1), ("v", 1, 40.0, 1200.0, 5.0, 2)], "vid string, pid int, at_s double, pdist double, age_s double, event_id long")
    stops = spark.createDataFrame([(1, "456", 1000.0)], "pid int, stop string, stop_pdist double")
    assert [r.arrival_s for r in arrivals.crossings(obs, stops).collect()] == [28]


def test_geometry(spark):
    row = spark.range(1).select(
        geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.heading_error(F.lit(350.0), F.lit(10.0)).alias("e"),
        *[c.alias(n) for c, n in zip(geo.segment_projection(F.lit(41.0), F.lit(-87.001), F.lit(41.0), F.lit(-87.0), F.lit(41.0), F.lit(-87.002)), ("t", "m"))],
    ).first()
    assert row.d == pytest.approx(111194.9, abs=1) and row.b == pytest.approx(90) and row.e == pytest.approx(20) and row.t == pytest.approx(0.5) and row.m == pytest.approx(0, abs=0.01)


def test_calibrated_forecasts_look_calibrated(spark):
    rng, mu, sigma = random.Random(7), 6.2, 0.4
    p50, p80 = 2.718281828459045**mu, 2.718281828459045 ** (mu + sigma * scores.Z80)
    rows = spark.createDataFrame([(i, "Red", p50, p80, rng.lognormvariate(mu, sigma), "resolved", 1.0, "v") for i in range(2000)], "forecast_id long, line string, p50 double, p80 double, actual double, status string, truth_confidence double, predictor_version string")
    good = cal.calibration_rows(rows)
    assert all(abs(r.observed - r.nominal) < 0.05 for r in cal.reliability_curve(good).collect())
    bars = cal.pit_histogram(good).collect()
    assert len(bars) == 10 and sum(r["count"] for r in bars) == 2000 and all(0.06 < r["count"] / 2000 < 0.14 for r in bars)
    assert cal.pit_shape(cal.pit_histogram(good)).first()["shape"] == "calibrated"
    assert cal.pit_histogram(good.limit(0), pooled=True).count() == 0
    assert abs(spark.range(1).select(scores.normal_cdf(F.lit(1.2815515)).alias("p")).first().p - 0.9) < 1e-6


def test_conformal_fold_follows_a_loop_and_covers(spark):
    rng = random.Random(1)
    data = [("k", 0.8, 100.0, rng.gauss(130, 20), i) for i in range(2000)]
    got = online.conformal_offsets(spark.createDataFrame(data, "k string, target double, raw double, seen double, i long").repartition(3), ["k"], ["i"]).first()
    fold = online.Conformal(0.8)
    for _, _, raw, seen, _ in data:
        fold.update(raw, seen)
    assert got.offset_s == pytest.approx(fold.offset, abs=1e-9) and got.n == 2000
    assert 0.75 < 1 - got.missed / got.n < 0.87


def test_promotion_needs_consecutive_wins(spark):
    def run(*scores_):
        rows = [("c", i, candidate, score, 0.15) for i, (candidate, score) in enumerate(scores_)]
        return online.promotions(spark.createDataFrame(rows, "corridor_id string, at long, candidate string, score double, incumbent_score double"), "kernel").first()

    assert run(("new", 0.10)).active == "kernel"
    assert run(("new", 0.10), ("new", 0.10)).active == "new"
    assert run(("new", 0.10), ("new", 0.149), ("new", 0.10)).active == "kernel"
    assert run(("a", 0.10), ("b", 0.10), ("a", 0.10), ("b", 0.10)).active == "kernel"


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", 2.0)], "k string, v long, s string, d double")
    new = spark.createDataFrame([("a", 2, None, 5.0), ("c", 2, "z", None), (None, 2, "n", 1.0), (None, 2, "n", 1.0)], old.schema)
    first = sinks.insert_if_absent(old, new, ["k"])
    assert sorted((r.k or "") for r in first.collect()) == ["", "c"]
    assert sinks.insert_if_absent(old.unionByName(first), new, ["k"]).count() == 0
    merged = {r.k: r for r in sinks.coalescing_upsert(old, new, ["k"], "v").collect()}
    assert (merged["a"].s, merged["a"].d, merged["a"].v) == ("x", 5.0, 2)
    once = sinks.overwrite(old, new, ["k"], "v")
    assert sorted(map(str, sinks.overwrite(once, new, ["k"], "v").collect())) == sorted(map(str, once.collect()))
    assert sinks.replace_keys(old, new.where("k = 'a'"), ["k"]).count() == 2


def test_conform_adds_casts_and_fills(spark):
    df = spark.createDataFrame([("7", "x"), ("bad", "y")], "n string, extra string")
    rows = sinks.conform(df, {"n": "int", "flag": "boolean"}, {"flag": F.lit(False)}).collect()
    assert [(r.n, r.flag) for r in rows] == [(7, False), (None, False)]
    scrubbed = spark.range(1).select(sinks.scrub_url(F.lit("http://a/b?x=1&KEY=abc&y=2")).alias("u"), sinks.scrub(F.create_map(F.lit("key"), F.lit("s"), F.lit("q"), F.lit("t"))).alias("m")).first()
    assert scrubbed.u == "http://a/b?x=1&KEY=<redacted>&y=2" and scrubbed.m == {"key": "<redacted>", "q": "t"}


def test_train_payloads(spark):
    eta = {"staId": "40330", "stpId": "1", "rn": "R1", "rt": "Red", "prdt": "2026-01-01T08:00:00", "arrT": "2026-01-01T08:02:00", "isApp": "1", "isDly": "0", "isFlt": "0", "isSch": "x"}
    body = lambda e, code="0": json.dumps({"ctatt": {"tmst": "2026-01-01T08:00:30", "errCd": code, "eta": e}})
    frame = spark.createDataFrame([(1, body([eta, {**eta, "rn": None}])), (2, body(eta)), (3, body([eta], "101")), (4, None), (5, "not json")], "poll_id long, body string")
    rows = ingest.train_arrivals(frame).collect()
    assert sorted(r.poll_id for r in rows) == [1, 2]
    assert (rows[0].eta_s, rows[0].prediction_age_s, rows[0].approaching, rows[0].scheduled) == (90.0, 30.0, True, None)
    where = json.dumps({"ctatt": {"route": {"@name": "red", "train": [{"rn": "1", "lat": "41.9", "lon": "bad"}, {"rn": "2"}]}}})
    both = ingest.train_positions(spark.createDataFrame([(1, where)], "poll_id long, body string")).orderBy("run").collect()
    assert [(r.line, r.run, r.lat, r.lon) for r in both] == [("red", "1", 41.9, None), ("red", "2", None, None)]


def test_bus_payloads_and_clocks(spark):
    body = json.dumps({"bustime-response": {"prd": [{"rt": "22", "stpid": "1", "vid": "8", "prdctdn": "DUE", "tmstmp": "20260101 08:00", "prdtm": "20260101 08:05", "dstp": "900"}, {"rt": "22", "stpid": "1", "prdctdn": "DLY"}], "error": [{"msg": "no data", "rt": "9"}]}})
    frame = spark.createDataFrame([(1, body)], "poll_id long, body string")
    rows = ingest.bus_predictions(frame).orderBy(F.col("vehicle").asc_nulls_last()).collect()
    assert [(r.minutes, r.approaching) for r in rows] == [(0.0, True), (None, False)]
    assert ingest.bus_errors(frame).first().msg == "no data"
    same = spark.range(1).select(ingest.clock(F.lit("1767254400")).alias("a"), ingest.clock(F.lit("1767254400000")).alias("b"), ingest.clock(F.lit("2026-01-01T08:00:00")).alias("c"), ingest.clock(F.lit("?")).alias("d")).first()
    assert same.a == same.b == same.c and same.d is None


def test_static_set_is_read_tolerantly(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_lat,extra\n1,41.9,x\n2,,y\n3,bad,z\n")
    rows = ingest.static_table(spark, str(tmp_path / "stops.txt"), {"stop_id": "string", "stop_lat": "double", "parent_station": "string"}).collect()
    assert [(r.stop_id, r.stop_lat, r.parent_station) for r in rows] == [("1", 41.9, None), ("2", None, None), ("3", None, None)]


def test_html_rows_and_fields(spark):
    html = "<table><tr><th>Line</th></tr><tr><td>Red Line SB</td><td>Between <b>Howard</b> and Wilson, 15 MPH</td></tr></table>"
    rows = ingest.html_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "tr", "td").collect()
    assert [r.cells for r in rows] == [[], ["Red Line SB", "Between Howard and Wilson, 15 MPH"]]
    fields = spark.range(1).select(*[c.alias(k) for k, c in ingest.slow_zone_fields(F.lit("Red Line SB Between Howard and Wilson, 15 MPH")).items()]).first()
    assert (fields.line, fields.mph, fields.from_station, fields.to_station) == ("Red", 15, "Howard", "Wilson")


@pytest.mark.parametrize("gaps, approaching, state", [([100], False, "good"), ([800, 900, 1000], False, "bad_gap"), ([500, 600, 1500, 2400], False, "bunched"), ([500], False, "risky"), ([300], False, "acceptable"), ([800], True, "good")])
def test_wait_classes(spark, gaps, approaching, state):
    asked = spark.createDataFrame([(1, "Red", 1, at(0))], "request_id long, line string, station long, leave_at timestamp_ntz")
    deps = spark.createDataFrame([("Red", 1, at(g), approaching) for g in gaps], "line string, station long, arrival_at timestamp_ntz, approaching boolean")
    row = predict.wait_forecasts(asked, deps, 7200.0).first()
    assert row.state == state and row.mean == gaps[0] and row.p50 <= row.p80 <= row.p90


def test_wait_without_departures(spark):
    asked = spark.createDataFrame([(1, "Red", 1, at(0))], "request_id long, line string, station long, leave_at timestamp_ntz")
    none = spark.createDataFrame([], "line string, station long, arrival_at timestamp_ntz, approaching boolean")
    assert predict.wait_forecasts(asked, none, 3600.0).first().state == "unknown"
    row = predict.wait_forecasts(asked, none, 3600.0, F.lit(600.0)).first()
    assert (row.state, row.mean, row.confidence) == ("feed_unreliable", 300.0, 0.4)


def test_bus_rules_withhold_severe_cases(spark):
    base = {"prediction_age_s": 10.0, "dyn": 0, "vehicle_found": True, "vehicle_age_s": 10.0, "same_route": True, "stop_pdist": 1000.0, "pdist": 500.0, "projected": 510.0, "map_quality": "HIGH", "eta_s": 40.0, "typ": "A", "speed_ftps": 20.0}
    frame = sinks.conform(spark.createDataFrame([{**base, "i": 1}, {**base, "i": 2, "dyn": 1}, {**base, "i": 3, "pdist": 1200.0}]), {"i": "int", **estimate.BUS_EVIDENCE})
    rows = {r.i: r for r in estimate.bus_estimates(frame).collect()}
    assert rows[1].arrival_s == pytest.approx(0.68 * 40 + 0.32 * 25) and not rows[1].abstain and rows[1].display == "high"
    assert rows[2].abstain and rows[2].arrival_s is None and "DYN_CANCELED" in rows[2].reasons
    assert rows[3].abstain and "PDIST_CROSSED_STOP" in rows[3].reasons


def test_residual_model_covers(spark):
    rng = random.Random(2)
    rows = [(i, "Red", "N", T0 + timedelta(hours=i), float(rng.randint(100, 900)), 0.0) for i in range(1500)]
    rows = [(i, line, d, t, x, 0.1 * x + rng.gauss(0, 30)) for i, line, d, t, x, _ in rows]
    frame = spark.createDataFrame(rows, "forecast_id long, line string, direction_code string, leave_at timestamp_ntz, horizon_s double, residual double")
    model = training.fit_residual_quantiles(frame, ["horizon_s"], rounds=12)
    got = training.apply_residual_quantiles(frame, model, ["horizon_s"])
    shares = got.agg(*[F.avg((F.col("residual") <= F.element_at("residual_q", F.lit(q))).cast("double")).alias(f"c{round(q * 100)}") for q in (0.5, 0.8, 0.9)]).first()
    assert abs(shares.c50 - 0.5) < 0.06 and abs(shares.c80 - 0.8) < 0.06 and abs(shares.c90 - 0.9) < 0.06


def test_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = jobs.run_once(jobs.windowed_counts(jobs.read_events(spark, f"{sf}/event[s].parquet")))
    by = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    closed = events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 10 minutes")).alias("t")).first().t
    want = by.where(F.col("w.end") <= F.lit(closed)).select(F.col("w.start").alias("start_at"), "event_type", "n")
    assert got.select("start_at", "event_type", "n").exceptAll(want).count() == 0 and got.count() == want.count() > 0
    assert jobs.run_once(jobs.first_seen(jobs.read_events(spark, f"{sf}/event[s].parquet"), ["event_id"])).count() == events.select("event_id").distinct().count()


def test_updates_of_later_batches_keep_the_keys_of_earlier_ones(spark, tmp_path):
    for key, n in (("a", 2), ("b", 3), ("a", 1)):
        spark.createDataFrame([(key, k) for k in range(n)], "key string, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = jobs.run_once(stream.groupBy("key").agg(F.count("*").alias("n")), "update", ["key"]).collect()
    assert sorted((r.key, r.n) for r in rows) == [("a", 3), ("b", 3)]


@pytest.mark.parametrize("remember", [False, True])
def test_stream_state_carries_over_batches(spark, tmp_path, remember):
    rng = random.Random(4)
    data = [("ab"[i % 2] if i < 40 else "c", at(i), 100.0, rng.gauss(130, 20) if i % 13 else None) for i in range(60)]
    schema = "key string, at timestamp, raw double, seen double"
    for part in range(3):
        spark.createDataFrame(data[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = {r.key: r for r in jobs.conformal_stream(stream, remember=remember).collect()}
    assert set(rows) == {"a", "b", "c"}
    for key, last in rows.items():
        fold = online.Conformal(0.8, remember)
        for _, _, raw, seen in (r for r in data if r[0] == key and r[3] is not None):
            fold.update(raw, seen)
        assert last.n == fold.n and last.offset_s == pytest.approx(fold.offset, abs=1e-9) and last.weights == pytest.approx(fold.weights)


def test_forecasts_that_nothing_meets_come_out_with_nulls(spark, tmp_path):
    f = [("k", T0), ("k", T0 + timedelta(hours=3)), ("z", T0), ("k", T0 + timedelta(days=2))]
    a = [("k", T0 + timedelta(minutes=5)), ("k", T0 + timedelta(hours=9)), ("k", T0 + timedelta(days=2, hours=9))]
    for k in range(2):
        spark.createDataFrame(f[k * 3 : k * 3 + 3], "key string, leave_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        spark.createDataFrame(a[k * 2 : k * 2 + 2], "a_key string, arrived_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    left = spark.readStream.schema("key string, leave_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    right = spark.readStream.schema("a_key string, arrived_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    rows = jobs.run_once(jobs.interval_join(left, right)).collect()
    assert sorted((r.key, r.arrived_at is None) for r in rows) == [("k", False), ("k", True), ("z", True)]


def test_a_standing_vehicle_passes_no_stop(spark):
    seen = [(7, 1, 0.0, 1000.0), (7, 1, 30.0, 1000.0), (7, 1, 60.0, 900.0), (7, 1, 90.0, 1600.0)]
    frame = spark.createDataFrame([(i, *r, None) for i, r in enumerate(seen)], "event_id long, vid long, pid int, at_s double, pdist double, age_s double")
    rows = arrivals.crossings(frame, spark.createDataFrame([(1, 5, 1000.0)], "pid int, stop long, stop_pdist double"), speed=(0.0, 110.0)).collect()
    assert [(r.vid, r.stop, r.arrival_s) for r in rows] == [(7, 5, 64)]


def test_json_of_equal_content_has_one_hash(spark):
    frame = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("not json",), ("not  json",)], "body string")
    hashes = [r.h for r in frame.select(sinks.content_hash(F.col("body")).alias("h")).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 3


def test_next_items_over_bins_ties_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a", 0.0), (2, "a", 95.0), (3, None, 0.0), (4, "b", 0.0), (5, "a", 300.0)], "id long, k string, t double")
    right = spark.createDataFrame([("a", 0.0, 2), ("a", 0.0, 1), ("a", 99.0, 3), ("a", 105.0, 4), ("a", 196.0, 5), (None, 1.0, 6)], "k string, u double, v long")
    got = joins.forward_asof(left, right, "id", ["k"], F.col("t"), F.col("u"), 100.0, 2).collect()
    assert sorted((r.id, r.nth, r.v) for r in got) == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)]
    last = {r.id: r.latest and r.latest.v for r in joins.latest_before(left, right, ["k"], F.col("t"), F.col("u")).collect()}
    assert last == {1: 2, 2: 2, 3: None, 4: None, 5: 5}


def test_ndjson_tail_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"query_id": "1", "success": true}\n{broken\n{"query_id": "2", "success": false}\n')
    rows = jobs.run_once(jobs.tail_ndjson(spark, str(tmp_path / "log"), "query_id string, success boolean"))
    assert sorted(r.query_id for r in rows.collect()) == ["1", "2"]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
