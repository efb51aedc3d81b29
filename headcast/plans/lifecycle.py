"""Queries of features and of the life of corridors and forecasts, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions.scores import rounded
from headcast.operators import detours, features, lifecycle, online, predict, sinks, training
from headcast.operators.joins import seconds_of
from headcast.plans.arrivals import E, NOW, NOW_COLUMN
from headcast.plans.calibration import scored
from headcast.plans.predictions import NEW_PAIRS, _conformal_sql, _steps_sql
from headcast.sources import proxies
from headcast.sources.proxies import sql

POLLED, AHEAD, STATE, BIAS = 10_800.0, 10_800.0, 1_800.0, 86_400.0
THEN = "1998-01-01 00:00:00"
THEN_COLUMN = lambda: F.lit(THEN).cast("timestamp_ntz")


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def far_arrivals(s: SparkSession, d: str) -> DataFrame:
    """Predictions up to four hours ahead."""
    return proxies.arrivals(s, d).withColumn("arrival_at", F.col("polled_at") + minutes(F.col("event_id") % 240))


def asked(s: SparkSession, d: str) -> DataFrame:
    return proxies.trip_requests(s, d).select(
        "request_id", "line", F.when(F.col("board") % 2 == 0, "north").otherwise("south").alias("direction_code"), "board", "alight", F.col("leave_at").alias("at"), F.lit("L").alias("mode"),
        (F.abs(F.col("alight") - F.col("board")) * 800.0).alias("haversine_meters"),
    )


def f15_live_features(s: SparkSession, d: str) -> DataFrame:
    positions = proxies.positions(s, d).withColumn("next_at", F.col("polled_at") + minutes(F.col("event_id") % 30))
    known = proxies.table(s, d, "events").select(
        F.col("event_type").alias("line"), F.when(F.col("user_id") % 2 == 0, "north").otherwise("south").alias("direction_code"), F.hour("ts").alias("hod"), F.col("ts").alias("resolved_at"), (F.col("value") - 100).alias("residual")
    )
    made = features.live_features(asked(s, d), far_arrivals(s, d), positions, known, POLLED, AHEAD, STATE, BIAS)
    # a hair is added to means, so that those half way between two thousandths go the same way in any engine
    scaled = made.withColumns({"run_arrival_variance_s": F.col("run_arrival_variance_s") / 1e6, "line_dir_hour_recent_mean_residual_s": F.col("line_dir_hour_recent_mean_residual_s") + 1e-7})
    return scaled.select("request_id", *features.TEXT, *[rounded(F.col(c), 3).alias(c) for c in (*features.STATIC, *features.DYNAMIC, "completeness")])


def f16_departure_snapshots(s: SparkSession, d: str) -> DataFrame:
    return features.departure_snapshot(asked(s, d), far_arrivals(s, d), POLLED, AHEAD)


def f16_trip_snapshots(s: SparkSession, d: str) -> DataFrame:
    trips = features.trip_snapshot(asked(s, d), far_arrivals(s, d), AHEAD)
    first = F.get("trips", F.lit(0))
    return trips.select("request_id", F.size("trips").alias("n"), first["run"].alias("run"), rounded(first["wait_s"], 3).alias("wait_s"), rounded(first["ride_s"], 3).alias("ride_s"))


def f19_warm_up(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where(F.col("status") == "resolved").select("predictor_version", "line", F.lit(0.9).alias("target"), F.col("p90").alias("raw"), F.col("actual").alias("seen"), "resolved_at", "forecast_id")
    out = online.warm_up(rows, ["predictor_version", "line"], ["resolved_at", "forecast_id"], 40)
    return out.select("predictor_version", "line", rounded(F.col("offset_s")).alias("offset_s"), "n", "missed")


def f20_state_updates(s: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("forecast_id") % 3 == 0, "gbm-v1").when(F.col("forecast_id") % 3 == 1, "kernel-v1+eb").otherwise("kernel-v1")
    rows = scored(s, d).where(F.col("status") == "resolved").select(
        "forecast_id", "mode", version.alias("predictor_version"), *[(F.col(c) * 0.25).alias(f"wait_{c}") for c in ("p50", "p80", "p90")], F.col("p80").alias("total_p80"), F.col("p90").alias("total_p90"),
        F.when(F.col("forecast_id") % 7 != 0, F.col("actual") * 0.25).alias("actual_wait"), F.col("actual").alias("actual_total"),
    )
    return online.state_updates(rows).groupBy("predictor_version", "kind", "leg", "target").agg(F.count("*").alias("n"), rounded(F.avg("raw"), 4).alias("raw"), rounded(F.avg("seen"), 4).alias("seen"))


def f23_first_predictions(s: SparkSession, d: str) -> DataFrame:
    """The active version's prediction of each corridor where it made one, else that of ``pv0``."""
    f = proxies.forecasts(s, d)
    made = f.where(~((F.col("predictor_version") == "pv2") & (F.col("corridor_id").endswith("3")))).groupBy("corridor_id", "predictor_version").agg(F.max_by("p80", F.struct("leave_at", "forecast_id")).alias("p80"))
    active = f.groupBy("corridor_id").agg(F.max("predictor_version").alias("version")).where("corridor_id <> 'c4'")
    return lifecycle.first_prediction(proxies.corridors(s, d), made, active, "pv0")


def known_corridors(s: SparkSession, d: str) -> DataFrame:
    last = proxies.forecasts(s, d).where(F.col("leave_at") <= THEN_COLUMN()).groupBy("corridor_id").agg(F.max("leave_at").alias("last_predicted_at"))
    return proxies.corridors(s, d).where("priority < 2").join(last, "corridor_id", "left")


def f25_seeded(s: SparkSession, d: str) -> DataFrame:
    specs = proxies.corridors(s, d).where("priority <> 1").withColumn("priority", F.col("priority") + 10)
    return lifecycle.seeded(known_corridors(s, d), specs, THEN_COLUMN()).select("corridor_id", "mode", "priority", "last_predicted_at", F.col("seeded_at").isNotNull().alias("is_new"))


def f28_marked(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.mark_predicted(known_corridors(s, d), known_corridors(s, d).where("mode = 'bus'"), THEN_COLUMN()).select("corridor_id", "last_predicted_at")


def f30_promoted(s: SparkSession, d: str) -> DataFrame:
    """Popular pairs become corridors if both ends are stops of the nations' catalogue."""
    existing = proxies.table(s, d, "supplier").select((F.col("s_suppkey") % 10).alias("origin"), (F.col("s_nationkey") % 10).cast("bigint").alias("destination"))
    popular = predict.popular_pairs(proxies.requests(s, d), existing, F.lit("2024-01-13 00:00:00").cast("timestamp_ntz"), 2)
    modes = popular.withColumns({"mode": F.when(F.col("origin") % 2 == 0, "L").otherwise("bus"), "line": F.concat(F.lit("R"), F.col("origin") % 3)})
    catalogue = proxies.table(s, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "bus").otherwise("L").alias("mode"), F.col("n_nationkey").cast("bigint").alias("stop"), F.col("n_name").alias("name"), (F.lit(41.0) + F.col("n_nationkey") / 100.0).alias("lat"), F.lit(-87.0).alias("lon"))
    known = s.createDataFrame([("auto-l-r1-4-7",)], "corridor_id string")
    return lifecycle.promoted(modes, catalogue, {"L": 600.0, "bus": 900.0}, known, THEN_COLUMN()).select("corridor_id", "mode", "line", "origin_label", "destination_label", "headway_s", "source", "promoted_from")


def f31_wait_legs(s: SparkSession, d: str) -> DataFrame:
    key = F.col("forecast_id")
    rows = proxies.forecasts(s, d).select(
        "forecast_id", (key % 13 == 0).alias("abstain"), F.when(key % 11 != 0, F.col("p50") - 350).alias("arrival_s"), F.when(key % 5 != 0, F.col("p80") - 350).alias("high80"), F.when(key % 7 != 0, F.col("p90") - 380).alias("high90"), (key % 100 / 100.0).alias("reliability")
    )
    return lifecycle.wait_legs(rows).select("forecast_id", *[rounded(F.col(c)).alias(c) for c in ("p50", "p80", "p90", "confidence")])


def queue(s: SparkSession, d: str) -> DataFrame:
    return predict.enqueue(proxies.forecasts(s, d).where("status <> 'unresolvable'").select("corridor_id", "leave_at", "predictor_version", "p90", "forecast_id", "mode"))


def f3_due_batch(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.due_forecasts(queue(s, d), THEN_COLUMN()).select("forecast_id", "mode", "resolve_after")


def st5_settled(s: SparkSession, d: str) -> DataFrame:
    moved = lifecycle.settled(queue(s, d), proxies.outcomes(s, d).where("truth_confidence >= 0.5"), THEN_COLUMN())
    return moved.groupBy("mode", "status").agg(F.count("*").alias("n"))


def f3_resolved_by_mode(s: SparkSession, d: str) -> DataFrame:
    name = lambda k: F.element_at(F.array(*map(F.lit, lifecycle.MODES)), (k % 4 + 1).cast("int"))
    requests = proxies.trip_requests(s, d).withColumn("mode", name(F.col("request_id")))
    seen = proxies.arrivals(s, d).select("line", "run", "station", F.col("arrival_at").alias("observed_at"), name(F.col("event_id") + F.floor(F.col("run") / 4)).alias("mode"))
    return lifecycle.resolve_by_mode(requests, seen, 172_800.0)


def f37_registry(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where(F.col("status") == "resolved")
    fitted = rows.groupBy("line").agg(F.percentile("p50_residual", 0.5).alias("b0"), F.avg("p50").alias("b1")).withColumn("q", F.lit(0.5))
    before = s.createDataFrame([("gbm-1", "1-URGENT", 0.5, "{}"), ("gbm-0", "1-URGENT", 0.5, "{}")], "version string, line string, q double, coefficients string").withColumn("fitted_at", F.lit("1990-01-01").cast("timestamp_ntz"))
    out = lifecycle.registered(before, fitted, "gbm-1", THEN_COLUMN())
    return out.select("version", "line", "q", rounded(F.get_json_object("coefficients", "$.b0").cast("double"), 4).alias("b0"), "fitted_at")


def f39_latest_residuals(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where(F.col("status") == "resolved").select("line", "direction_code", "resolved_at", "forecast_id", rounded(F.col("p50_residual")).alias("residual"))
    return lifecycle.newest_rows(rows, ["line", "direction_code"], "resolved_at", 5)


def g29_recent_residual(s: SparkSession, d: str) -> DataFrame:
    """Mean residual of what was resolved for a pending forecast's line, direction and hour in the 30 days before it."""
    f = proxies.forecasts(s, d).where(F.col("status") == "pending").select(F.col("forecast_id").alias("request_id"), "line", "direction_code", F.col("leave_at").alias("at"))
    known = scored(s, d).where(F.col("status") == "resolved").select("line", "direction_code", F.hour("leave_at").alias("hod"), "resolved_at", F.col("p50_residual").alias("residual"))
    out = features.recent_residual(f, known, 2_592_000.0)
    return out.select(F.col("request_id").alias("forecast_id"), rounded(F.col("line_dir_hour_recent_mean_residual_s")).alias("mean_residual"))


def g30_headways(s: SparkSession, d: str) -> DataFrame:
    """Headways at each stop over the day after now."""
    ahead = seconds_of(F.col("arrival_at")) - seconds_of(NOW_COLUMN())
    rows = proxies.arrivals(s, d).select("line", "station", ahead.alias("t")).where("t between 0 and 86400").groupBy("line", "station").agg(F.array_sort(F.collect_set("t")).alias("times"))
    return rows.select("line", "station", F.size("times").alias("n"), *[rounded(c, 3).alias(k) for k, c in features.headways(F.col("times")).items()])


def g32_window_evaluation(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where(F.col("status") == "resolved").withColumns({**{f"wait_{c}": F.col(c) * 0.25 for c in ("p50", "p80", "p90")}, "actual_wait": F.when(F.col("forecast_id") % 9 != 0, F.col("actual") * 0.25)})
    return lifecycle.window_evaluation(rows, F.lit("1994-01-01").cast("timestamp_ntz"), THEN_COLUMN())


def g35_feed_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of a static schedule set per agency: here regions, their nations, and the customers and suppliers in them."""
    per = lambda name, key, label: proxies.table(s, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(label))
    stops = proxies.table(s, d, "nation").join(per("customer", "c_nationkey", "trips"), "n_nationkey", "left").join(per("supplier", "s_nationkey", "routes"), "n_nationkey", "left")
    by = stops.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n_stops"), F.coalesce(F.sum("trips"), F.lit(0)).alias("n_trips"), F.coalesce(F.sum("routes"), F.lit(0)).alias("n_routes"))
    return proxies.table(s, d, "region").join(by, "r_regionkey", "left").select(F.col("r_name").alias("agency"), "n_stops", "n_trips", "n_routes")


def g41_latest_clock(s: SparkSession, d: str) -> DataFrame:
    return proxies.polls(s, d).groupBy("endpoint").agg(F.max(F.when(F.col("ok"), F.col("responded_at"))).alias("latest_clock"))


def g23_severity(s: SparkSession, d: str) -> DataFrame:
    rows = proxies.arrivals(s, d).withColumns({"dyn": (F.col("event_id") % 23).cast("int"), "flagstop": F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 3).cast("int"))})
    return detours.group_severity(rows, ["line", "run", "station"]).withColumn("max_flagstop", F.coalesce("max_flagstop", F.lit(-1)))


def k6_replaced(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d).select("line", "station", "event_id")
    return sinks.replace_keys(a.where("event_id % 3 <> 0"), a.where("event_id % 3 = 0 and station < 10"), ["line", "station"])


def k9_conformed(s: SparkSession, d: str) -> DataFrame:
    """Texts that aren't numbers become null, missing columns are added, defaults fill, foreign columns go."""
    raw = proxies.table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"), "value", "props")
    return sinks.conform(raw, {"event_id": "bigint", "user_id": "bigint", "agency": "string", "note": "string"}, {"agency": F.lit("none"), "user_id": F.lit(-1)})


def k11_body_text(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "text/html; charset=utf-8").otherwise("application/octet-stream")
    return proxies.table(s, d, "pages").select("page_id", F.sha2(sinks.body_text(F.col("url").cast("binary"), kind), 256).alias("body_sha"), F.substring(sinks.body_text(F.col("url").cast("binary"), kind), 1, 7).alias("head"))


def k13_purged(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.purged(proxies.forecasts(s, d).select("forecast_id", "predictor_version", "line"), predictor_version="pv1", line="1-URGENT")


def s35_feature_json(s: SparkSession, d: str) -> DataFrame:
    """Features written as JSON and read back for training, with the residual label beside them."""
    rows = scored(s, d).where(F.col("status") == "resolved").select("forecast_id", "line", F.when(F.col("forecast_id") % 3 != 0, F.hour("leave_at").cast("double")).alias("hour_of_day"), (F.col("p50") / 2).alias("headway_min_s"), "p50_residual")
    text = rows.select("forecast_id", features.as_json(rows).alias("feature_json"), "p50_residual")
    got = features.from_json(F.col("feature_json"), ["hour_of_day", "headway_min_s", "headway_iqr_s"], ["line", "mode"])
    return text.select("forecast_id", *[(F.nanvl(c, F.lit(-1.0)) if k not in features.TEXT else c).alias(k) for k, c in got.items()], rounded(F.col("p50_residual")).alias("residual"))


def f36_shifted_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Forecasts shifted by a fixed model's residual quantiles, kept in order and at zero or more."""
    frame = training.training_frame(scored(s, d), F.col("p50") - 200, 0.25)
    model = frame.select("line").distinct().select("line", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("b0"), F.lit(b).alias("b1")) for q, a, b in ((0.5, -400.0, 0.5), (0.8, 60.0, -0.25), (0.9, 90.0, 0.125))])).alias("m")).select("line", "m.*")
    rows = training.apply_residual_quantiles(frame, model, ["horizon_s"])
    at = lambda q: F.col("p50") + F.element_at("residual_q", F.lit(q))
    return rows.select("forecast_id", *[rounded(c).alias(n) for n, c in zip(("q50", "q80", "q90"), predict.monotone(at(0.5), at(0.8), at(0.9)))])


FAMILY = (
    f15_live_features, f16_departure_snapshots, f16_trip_snapshots, f19_warm_up, f20_state_updates, f23_first_predictions, f25_seeded, f28_marked, f30_promoted, f31_wait_legs, f3_due_batch, st5_settled, f3_resolved_by_mode, f37_registry,
    f39_latest_residuals, g29_recent_residual, g30_headways, g32_window_evaluation, g35_feed_totals, g41_latest_clock, g23_severity, k6_replaced, k9_conformed, k11_body_text, k13_purged, s35_feature_json, f36_shifted_quantiles,
)
QUERIES = {f.__name__: f for f in FAMILY}

FAR = "SELECT * REPLACE (polled_at + INTERVAL 1 MINUTE * (event_id % 240)::INTEGER AS arrival_at) FROM arrivals"
ASKED = "SELECT request_id, line, CASE WHEN board % 2 = 0 THEN 'north' ELSE 'south' END AS direction_code, board, alight, leave_at AS at_, abs(alight - board) * 800.0::DOUBLE AS meters FROM trip_requests"
COMING = f"""SELECT request_id, list({{'arrives': arrives, 'app': n.app, 'run': n.run}} ORDER BY arrives) AS c FROM (SELECT r.request_id, {E('a.arrival_at')} - {E('r.at_')} AS arrives, arg_max({{'app': a.approaching, 'run': a.run}}, (a.polled_at, a.event_id)) AS n
  FROM asked r JOIN far a ON a.line = r.line AND a.station = r.board AND NOT a.fault AND {E('r.at_')} - {E('a.polled_at')} BETWEEN 0 AND {POLLED} AND {E('a.arrival_at')} - {E('r.at_')} BETWEEN 0 AND {AHEAD} GROUP BY ALL) GROUP BY request_id"""
LIVE = {"far": FAR, "asked": ASKED, "coming": COMING}
GAPS = "list_sort(list_transform(range(2, len({0}) + 1), lambda i: {0}[i] - {0}[i - 1]))"
HEADWAYS = """round(CASE WHEN len(g) > 0 THEN g[1 + len(g) // 2] END, 3) AS headway_median_s, round(CASE WHEN len(g) >= 4 THEN g[1 + 3 * len(g) // 4] - g[1 + len(g) // 4] WHEN len(g) > 0 THEN g[len(g)] - g[1] END, 3) AS headway_iqr_s,
  round(CASE WHEN len(g) > 0 THEN g[1] END, 3) AS headway_min_s"""
KNOWN = "+".join(f"({c} IS NOT NULL)::INTEGER" for c in features.DYNAMIC)
MODE = "(['l', 'bus', 'metra', 'intercampus'])[({}) % 4 + 1]"

ORACLE = {
    "f15_live_features": sql(
        f"""SELECT *, round(({KNOWN}) / {len(features.DYNAMIC)}::DOUBLE, 3) AS completeness FROM made""", "arrivals", "positions", "trip_requests", **LIVE,
        next_="SELECT r.*, c.c, c.c[1].run AS run FROM asked r LEFT JOIN coming c USING (request_id)",
        hist=f"SELECT n.request_id, count(*)::DOUBLE AS seen, var_pop({E('a.arrival_at')}) / 1e6 AS variance, max({E('a.arrival_at')}) - min({E('a.arrival_at')}) AS drift FROM next_ n JOIN far a ON a.line = n.line AND a.run = n.run AND a.station = n.board AND a.polled_at <= n.at_ GROUP BY ALL",
        pos=f"SELECT n.request_id, {E('n.at_')} - {E('max(p.polled_at)')} AS age, {E('arg_max(p.next_at, (p.polled_at, p.next_at))')} - {E('n.at_')} AS ahead FROM next_ n JOIN (SELECT *, polled_at + INTERVAL 1 MINUTE * (event_id % 30)::INTEGER AS next_at FROM positions) p ON p.line = n.line AND p.run = n.run AND p.station = n.board AND p.polled_at <= n.at_ GROUP BY n.request_id, n.at_",
        sys=f"SELECT r.request_id, count(*) FILTER (WHERE a.delayed) AS d, count(*) FILTER (WHERE a.fault) AS f, count(DISTINCT a.run) AS n FROM asked r JOIN arrivals a ON a.line = r.line AND {E('r.at_')} - {E('a.polled_at')} BETWEEN 0 AND {STATE} GROUP BY 1",
        bias=f"SELECT r.request_id, avg(e.value - 100) AS m FROM asked r JOIN events e ON e.event_type = r.line AND (CASE WHEN e.user_id % 2 = 0 THEN 'north' ELSE 'south' END) = r.direction_code AND extract(hour FROM e.ts) = extract(hour FROM r.at_) AND {E('r.at_')} - {E('e.ts')} BETWEEN 0 AND {BIAS} GROUP BY 1",
        made=f"""SELECT request_id, line, direction_code, CAST(board AS VARCHAR) AS boarding_map_id, CAST(alight AS VARCHAR) AS alighting_map_id, CASE WHEN extract(dow FROM at_) BETWEEN 1 AND 5 THEN 'weekday' ELSE 'weekend' END AS weekday_or_weekend, 'L' AS mode,
          extract(hour FROM at_)::DOUBLE AS hour_of_day, round(meters, 3) AS haversine_meters, round(c[1].arrives, 3) AS seconds_until_next_arrival, c[1].app::INTEGER::DOUBLE AS next_is_approaching, coalesce(len(c), 0)::DOUBLE AS n_upcoming_arrivals_30m, {HEADWAYS},
          seen AS run_n_predictions_seen, round(variance, 3) AS run_arrival_variance_s, round(drift, 3) AS run_drift_s, coalesce(d, 0)::DOUBLE AS line_delayed_5m, coalesce(f, 0)::DOUBLE AS line_fault_5m, coalesce(n, 0)::DOUBLE AS line_n_runs_5m,
          round(age, 3) AS position_age_s, round(ahead, 3) AS position_next_arrival_offset_s, round(m + 1e-7, 3) AS line_dir_hour_recent_mean_residual_s
          FROM (SELECT *, {GAPS.format('list_transform(c, lambda x: x.arrives)')} AS g FROM next_) LEFT JOIN hist USING (request_id) LEFT JOIN pos USING (request_id) LEFT JOIN sys USING (request_id) LEFT JOIN bias USING (request_id)"""),
    "f16_departure_snapshots": sql("""SELECT request_id, coalesce('[' || array_to_string(list_transform(c[1:10], lambda x: '{"arrives_s":' || CAST(x.arrives AS DOUBLE)::VARCHAR || ',"is_approaching":' || x.app || ',"run":"' || x.run || '"}'), ',') || ']', '[]') AS live_departures,
      CAST(coalesce(len(c[1:10]), 0) AS INTEGER) AS n FROM asked LEFT JOIN coming USING (request_id)""", "arrivals", "trip_requests", **LIVE),
    "f16_trip_snapshots": sql(f"""SELECT request_id, CAST(least(count(*), 6) AS INTEGER) AS n, arg_min(run, (leaves, run)) AS run, round(min({E('leaves')}) - any_value({E('at_')}), 3) AS wait_s, round(arg_min({E('arrives')} - {E('leaves')}, (leaves, run)), 3) AS ride_s FROM (SELECT r.request_id, r.at_, b.run, b.t AS leaves, e.t AS arrives
      FROM asked r JOIN latest b ON b.line = r.line AND b.station = r.board AND {E('b.t')} - {E('r.at_')} BETWEEN 0 AND {AHEAD} JOIN latest e ON e.line = r.line AND e.run = b.run AND e.station = r.alight AND e.t > b.t) GROUP BY request_id""",
      "arrivals", "trip_requests", **LIVE, latest="SELECT line, run, station, max(arrival_at) AS t FROM far GROUP BY ALL"),
    "f19_warm_up": sql(f"""SELECT predictor_version, line, round(s.off, 6) AS offset_s, s.n AS n, s.missed AS missed FROM (SELECT predictor_version, line, {_conformal_sql('0.9::DOUBLE')} AS s FROM (SELECT predictor_version, line, {_steps_sql('p90', 'actual', 'resolved_at, forecast_id')} AS steps
      FROM (SELECT *, row_number() OVER (PARTITION BY predictor_version, line ORDER BY resolved_at DESC, forecast_id DESC) AS k FROM scored WHERE status = 'resolved') WHERE k <= 40 AND actual IS NOT NULL GROUP BY ALL))""", "scored"),
    "f20_state_updates": sql("""SELECT v AS predictor_version, u.kind AS kind, u.leg AS leg, u.target AS target, count(*) AS n, round(avg(u.raw), 4) AS raw, round(avg(u.seen), 4) AS seen FROM (SELECT v, unnest(CASE v WHEN 'gbm-v1' THEN [
      {'kind': 'conformal', 'leg': 'wait', 'target': 0.8::DOUBLE, 'raw': p80 * 0.25, 'seen': w}, {'kind': 'conformal', 'leg': 'wait', 'target': 0.9::DOUBLE, 'raw': p90 * 0.25, 'seen': w},
      {'kind': 'conformal', 'leg': 'total', 'target': 0.8::DOUBLE, 'raw': p80, 'seen': actual}, {'kind': 'conformal', 'leg': 'total', 'target': 0.9::DOUBLE, 'raw': p90, 'seen': actual}]
      WHEN 'kernel-v1+eb' THEN [{'kind': 'shift', 'leg': 'wait', 'target': 0.5::DOUBLE, 'raw': p50 * 0.25, 'seen': w}] END) AS u FROM (SELECT *, CASE WHEN forecast_id % 7 <> 0 THEN actual * 0.25 END AS w,
      CASE forecast_id % 3 WHEN 0 THEN 'gbm-v1' WHEN 1 THEN 'kernel-v1+eb' ELSE 'kernel-v1' END AS v FROM scored WHERE status = 'resolved' AND mode = 'l')) WHERE u.seen IS NOT NULL GROUP BY ALL""", "scored"),
    "f23_first_predictions": sql("""SELECT corridor_id, coalesce(own.v, other.v) AS predictor_version, coalesce(own.p, other.p) AS p80, own.v IS NULL AS fell_back FROM (SELECT c.corridor_id, max({'v': m.predictor_version, 'p': m.p80}) FILTER (WHERE m.predictor_version = coalesce(a.version, 'pv0')) AS own,
      max({'v': m.predictor_version, 'p': m.p80}) FILTER (WHERE m.predictor_version = 'pv0') AS other FROM corridors c LEFT JOIN (SELECT corridor_id, max(predictor_version) AS version FROM forecasts WHERE corridor_id <> 'c4' GROUP BY 1) a USING (corridor_id)
      JOIN (SELECT corridor_id, predictor_version, arg_max(p80, (leave_at, forecast_id)) AS p80 FROM forecasts WHERE NOT (predictor_version = 'pv2' AND ends_with(corridor_id, '3')) GROUP BY ALL) m USING (corridor_id) GROUP BY c.corridor_id) WHERE own IS NOT NULL OR other IS NOT NULL""", "forecasts", "corridors"),
    "f25_seeded": sql("""SELECT coalesce(s.corridor_id, k.corridor_id) AS corridor_id, coalesce(s.mode, k.mode) AS mode, coalesce(s.priority + 10, k.priority) AS priority, k.last AS last_predicted_at, s.corridor_id IS NOT NULL AS is_new
      FROM (SELECT c.*, l.last FROM corridors c LEFT JOIN last_ l USING (corridor_id) WHERE priority < 2) k FULL JOIN (SELECT * FROM corridors WHERE priority <> 1) s USING (corridor_id)""", "forecasts", "corridors", last_=f"SELECT corridor_id, max(leave_at) AS last FROM forecasts WHERE leave_at <= TIMESTAMP '{THEN}' GROUP BY 1"),
    "f28_marked": sql(f"SELECT c.corridor_id, CASE WHEN mode = 'bus' THEN TIMESTAMP '{THEN}' ELSE l.last END AS last_predicted_at FROM corridors c LEFT JOIN last_ l USING (corridor_id) WHERE priority < 2", "forecasts", "corridors", last_=f"SELECT corridor_id, max(leave_at) AS last FROM forecasts WHERE leave_at <= TIMESTAMP '{THEN}' GROUP BY 1"),
    "f30_promoted": sql(f"""SELECT corridor_id, mode, line, origin_label, destination_label, headway_s, 'auto_upgraded' AS source, n AS promoted_from FROM (SELECT lower('auto-' || p.mode || '-' || p.line || '-' || p.origin || '-' || p.destination) AS corridor_id, p.mode, p.line, a.n_name AS origin_label, b.n_name AS destination_label,
      CASE p.mode WHEN 'L' THEN 600.0::DOUBLE ELSE 900.0::DOUBLE END AS headway_s, p.n FROM (SELECT *, CASE WHEN origin % 2 = 0 THEN 'L' ELSE 'bus' END AS mode, 'R' || (origin % 3) AS line FROM (SELECT origin, destination, count(*) AS n FROM requests r WHERE queried_at >= TIMESTAMP '2024-01-13' AND success
      AND NOT EXISTS (SELECT 1 FROM {NEW_PAIRS} p WHERE p.origin = r.origin AND p.destination = r.destination) GROUP BY ALL HAVING count(*) >= 2)) p JOIN cat a ON a.mode = p.mode AND a.n_nationkey = p.origin JOIN cat b ON b.mode = p.mode AND b.n_nationkey = p.destination) WHERE corridor_id <> 'auto-l-r1-4-7'""",
      "requests", cat="SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 'bus' ELSE 'L' END AS mode FROM nation"),
    "f31_wait_legs": sql("""SELECT forecast_id, round(a, 6) AS p50, round(b, 6) AS p80, round(greatest(b, coalesce(h90, b)), 6) AS p90, (forecast_id % 100) / 100.0::DOUBLE AS confidence FROM (SELECT *, greatest(a, coalesce(h80, a)) AS b FROM (SELECT forecast_id, greatest(0, p50 - 350)::DOUBLE AS a, CASE WHEN forecast_id % 5 <> 0 THEN p80 - 350 END AS h80,
      CASE WHEN forecast_id % 7 <> 0 THEN p90 - 380 END AS h90 FROM forecasts WHERE forecast_id % 13 <> 0 AND forecast_id % 11 <> 0))""", "forecasts"),
    "f3_due_batch": sql(f"SELECT forecast_id, mode, due AS resolve_after FROM q WHERE due <= TIMESTAMP '{THEN}' ORDER BY due, forecast_id LIMIT 200", "forecasts",
      q="SELECT *, make_timestamp(CAST(floor((epoch_us(leave_at) / 1e6 + p90 + 600) * 1000000) AS BIGINT)) AS due FROM forecasts WHERE status <> 'unresolvable'"),
    "st5_settled": sql(f"""SELECT mode, CASE WHEN due > TIMESTAMP '{THEN}' THEN 'pending' WHEN o.forecast_id IS NOT NULL THEN 'resolved' WHEN epoch_us(TIMESTAMP '{THEN}') / 1e6 >= epoch_us(due) / 1e6 + 300 THEN 'unresolvable' ELSE 'pending' END AS status, count(*) AS n
      FROM q LEFT JOIN (SELECT forecast_id FROM outcomes WHERE truth_confidence >= 0.5) o USING (forecast_id) GROUP BY ALL""", "forecasts", "outcomes",
      q="SELECT *, make_timestamp(CAST(floor((epoch_us(leave_at) / 1e6 + p90 + 600) * 1000000) AS BIGINT)) AS due FROM forecasts WHERE status <> 'unresolvable'"),
    "f3_resolved_by_mode": sql(f"""SELECT request_id, mode, run, CAST(nth AS INTEGER) AS nth, boarded_at, alighted_at, {E('boarded_at')} - {E('leave_at')} AS wait_s, {E('alighted_at')} - {E('boarded_at')} AS ride_s, {E('alighted_at')} - {E('leave_at')} AS total_s FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY nth) AS k FROM rides) WHERE k = 1""",
      "arrivals", "trip_requests", seen=f"SELECT DISTINCT {MODE.format('event_id + run // 4')} AS mode, CASE WHEN {MODE.format('event_id + run // 4')} = 'intercampus' THEN '' ELSE line END AS line, run, station, arrival_at AS t FROM arrivals",
      req=f"SELECT request_id, {MODE.format('request_id')} AS mode, CASE WHEN {MODE.format('request_id')} = 'intercampus' THEN '' ELSE line END AS line, board, alight, leave_at FROM trip_requests",
      five=f"SELECT * FROM (SELECT r.*, o.run, o.t AS boarded_at, row_number() OVER (PARTITION BY request_id ORDER BY o.t, o.run) AS nth FROM req r JOIN seen o ON o.mode = r.mode AND o.line = r.line AND o.station = r.board AND {E('o.t')} - {E('r.leave_at')} BETWEEN 0 AND 172800 WHERE r.mode IN ('l', 'bus') OR r.board <> r.alight) WHERE nth <= 5",
      rides="SELECT f.request_id, f.mode, f.run, f.nth, f.boarded_at, f.leave_at, min(o.t) AS alighted_at FROM five f JOIN seen o ON o.mode = f.mode AND o.line = f.line AND o.run = f.run AND o.station = f.alight AND (o.t > f.boarded_at OR f.mode IN ('l', 'bus') AND o.t = f.boarded_at) GROUP BY ALL"),
    "f37_registry": sql(f"""SELECT 'gbm-1' AS version, line, 0.5::DOUBLE AS q, round(median(p50_residual), 4) AS b0, TIMESTAMP '{THEN}' AS fitted_at FROM scored WHERE status = 'resolved' GROUP BY line UNION ALL SELECT 'gbm-0', '1-URGENT', 0.5::DOUBLE, NULL, TIMESTAMP '1990-01-01'""", "scored"),
    "f39_latest_residuals": sql("""SELECT line, direction_code, resolved_at, forecast_id, residual, CAST(place AS INTEGER) AS place FROM (SELECT line, direction_code, resolved_at, forecast_id, round(p50_residual, 6) AS residual, row_number() OVER (PARTITION BY line, direction_code ORDER BY resolved_at DESC, forecast_id) AS place
      FROM scored WHERE status = 'resolved') WHERE place <= 5""", "scored"),
    "g29_recent_residual": sql(f"""SELECT f.forecast_id, round(avg(o.p50_residual), 6) AS mean_residual FROM forecasts f JOIN scored o ON o.status = 'resolved' AND o.line = f.line AND o.direction_code = f.direction_code AND extract(hour FROM o.leave_at) = extract(hour FROM f.leave_at)
      AND {E('f.leave_at')} - {E('o.resolved_at')} BETWEEN 0 AND 2592000 WHERE f.status = 'pending' GROUP BY 1""", "scored"),
    "g30_headways": sql(f"""SELECT line, station, CAST(len(t) AS INTEGER) AS n, {HEADWAYS} FROM (SELECT *, {GAPS.format('t')} AS g FROM (SELECT line, station, list(DISTINCT {E('arrival_at')} - epoch(TIMESTAMP '{NOW}') ORDER BY {E('arrival_at')} - epoch(TIMESTAMP '{NOW}')) AS t FROM arrivals
      WHERE {E('arrival_at')} - epoch(TIMESTAMP '{NOW}') BETWEEN 0 AND 86400 GROUP BY ALL))""", "arrivals"),
    "g32_window_evaluation": sql(f"""SELECT predictor_version, count(*) AS n, {', '.join(f"round(avg(greatest({q}::DOUBLE * (w - p{round(100 * q)} * 0.25), ({q}::DOUBLE - 1) * (w - p{round(100 * q)} * 0.25))), 6) AS pinball_{round(100 * q)}" for q in (0.5, 0.8, 0.9))},
      round(avg(CASE WHEN w <= p80 * 0.25 THEN 1.0 ELSE 0.0 END), 6) AS coverage_80, round(avg(abs(w - p50 * 0.25)), 6) AS mae FROM (SELECT *, actual * 0.25 AS w FROM scored WHERE status = 'resolved' AND forecast_id % 9 <> 0) WHERE resolved_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '{THEN}' GROUP BY 1""", "scored"),
    "g35_feed_totals": """SELECT r_name AS agency, count(n_nationkey) AS n_stops, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_trips, CAST(coalesce(sum(s), 0) AS BIGINT) AS n_routes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
      LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1""",
    "g41_latest_clock": sql("SELECT endpoint, max(responded_at) FILTER (WHERE ok) AS latest_clock FROM polls GROUP BY 1", "polls"),
    "g23_severity": sql("""SELECT line, run, station, max(dyn) AS max_dyn, coalesce(max(flag), -1) AS max_flagstop, bool_or(dyn IN (1, 4, 12, 16, 17, 18)) AS severe, concat_ws(',', CASE WHEN bool_or(delayed) THEN 'delayed' END, CASE WHEN bool_or(coalesce(flag = 2, false)) THEN 'discharge_only' END,
      CASE WHEN bool_or(dyn IN (1, 4, 12, 16, 17, 18)) THEN 'severe_dyn' END) AS reasons FROM (SELECT *, CAST(event_id % 23 AS INTEGER) AS dyn, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS INTEGER) END AS flag FROM arrivals) GROUP BY line, run, station""", "arrivals"),
    "k6_replaced": sql("""SELECT line, station, event_id FROM arrivals WHERE event_id % 3 = 0 AND station < 10 UNION ALL SELECT line, station, event_id FROM arrivals a WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM arrivals b WHERE b.event_id % 3 = 0 AND b.station < 10 AND b.line = a.line AND b.station = a.station)""", "arrivals"),
    "k9_conformed": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id ELSE -1 END AS user_id, 'none' AS agency, NULL::VARCHAR AS note FROM events",
    "k11_body_text": "SELECT page_id, sha256(t) AS body_sha, substr(t, 1, 7) AS head FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'BASE64:' || base64(encode(url)) END AS t FROM pages)",
    "k13_purged": sql("SELECT forecast_id, predictor_version, line FROM forecasts WHERE NOT (predictor_version = 'pv1' AND line = '1-URGENT')", "forecasts"),
    "s35_feature_json": sql("SELECT forecast_id, CASE WHEN forecast_id % 3 <> 0 THEN extract(hour FROM leave_at)::DOUBLE ELSE -1 END::DOUBLE AS hour_of_day, p50 / 2 AS headway_min_s, -1.0::DOUBLE AS headway_iqr_s, line, '' AS mode, round(p50_residual, 6) AS residual FROM scored WHERE status = 'resolved'", "scored"),
    "f36_shifted_quantiles": sql("""SELECT forecast_id, round(a, 6) AS q50, round(b, 6) AS q80, round(greatest(b, p50 + 90 + 0.125::DOUBLE * h), 6) AS q90 FROM (SELECT *, greatest(a, p50 + 60 - 0.25::DOUBLE * h) AS b FROM (SELECT forecast_id, p50, p50 - 200 AS h, greatest(0, p50 - 400 + 0.5::DOUBLE * (p50 - 200))::DOUBLE AS a FROM scored
      WHERE status = 'resolved' AND actual IS NOT NULL AND coalesce(truth_confidence, 0) >= 0.25 AND p50 - 200 >= 90))""", "scored"),
}
