"""Queries of the prediction, learning, ingestion, sink and streaming families, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headcast.functions.scores import rounded
from headcast.operators import online, predict, sinks, training
from headcast.operators.calibration import share
from headcast.operators.joins import seconds_of
from headcast.plans.arrivals import E, NOW, NOW_COLUMN
from headcast.plans.calibration import HOD, scored
from headcast.sources import ingest, proxies
from headcast.sources.proxies import sql
from headcast.streaming import jobs

WAIT_WINDOW = 86_400.0


def f10_wait_forecasts(s: SparkSession, d: str) -> DataFrame:
    asked = proxies.trip_requests(s, d).select("request_id", "line", F.col("board").alias("station"), "leave_at")
    waits = predict.wait_forecasts(asked, proxies.arrivals(s, d).select("line", "station", "arrival_at", "approaching"), WAIT_WINDOW, F.when(F.col("station") % 2 == 0, 900.0))
    return waits.select("request_id", "state", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "sigma", "confidence", "p_5min", "p_10min", "p_15min", "p50", "p80", "p90")])


def f11_trip_predictions(s: SparkSession, d: str) -> DataFrame:
    """Wait and ride legs of each request, summed quantile by quantile."""
    waits = f10_wait_forecasts(s, d).select("request_id", F.struct("p50", "p80", "p90", "confidence").alias("wait"))
    asked = proxies.trip_requests(s, d).select("request_id", (F.abs(F.col("alight") - F.col("board")) * 800.0).alias("distance_m"))
    ride = predict.in_vehicle_seconds(F.col("distance_m"), 10.0, 25.0)
    sigma = F.greatest(F.lit(60.0), 0.12 * ride)
    legs = asked.withColumn("ride", F.struct(*[v.alias(k) for k, v in predict.gaussian(ride, sigma).items()], F.lit(0.7).alias("confidence")))
    total = predict.add_legs(waits.join(legs, "request_id"), "wait", "ride")
    return total.select("request_id", *[rounded(F.col(c), 3).alias(c) for c in ("p50", "p80", "p90")], rounded(F.col("confidence"), 4).alias("confidence"))


def f17_shrunk_shift(s: SparkSession, d: str) -> DataFrame:
    moments = online.running_moments(scored(s, d).where(F.col("status") == "resolved"), ["line", "direction_code"], F.col("p50_residual"))
    return moments.select("line", "direction_code", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("variance"), 3).alias("variance"), rounded(predict.shrunk_shift(F.col("mean"), F.col("n"))).alias("shift"))


def f18_conformal_offsets(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).where(F.col("status") == "resolved").select("predictor_version", "line", F.lit(0.8).alias("target"), F.col("p80").alias("raw"), F.col("actual").alias("seen"), "resolved_at", "forecast_id")
    out = online.conformal_offsets(rows, ["predictor_version", "line"], ["resolved_at", "forecast_id"])
    return out.select("predictor_version", "line", rounded(F.col("offset_s")).alias("offset_s"), rounded(F.col("step_size")).alias("step_size"), "n", "missed")


def evaluations(s: SparkSession, d: str) -> DataFrame:
    """Daily scores of each version on each corridor, beside an incumbent's score."""
    day = F.to_date("resolved_at").alias("at")
    scores = scored(s, d).where(F.col("status") == "resolved").groupBy("corridor_id", day, F.col("predictor_version").alias("candidate")).agg(rounded(F.avg(F.abs("p50_residual"))).alias("score"))
    return scores.withColumn("incumbent_score", F.lit(300.0))


def f21_promotions(s: SparkSession, d: str) -> DataFrame:
    return online.promotions(evaluations(s, d), "pv0")


def f24_due_corridors(s: SparkSession, d: str) -> DataFrame:
    last = proxies.forecasts(s, d).where(F.col("leave_at") <= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("corridor_id").agg(F.max("leave_at").alias("last_predicted_at"))
    known = proxies.corridors(s, d).join(last, "corridor_id", "left").withColumns({"is_active": F.col("priority") < 2, "cadence_s": F.lit(3600.0)})
    return predict.due_corridors(known, F.lit("1998-01-01").cast("timestamp_ntz"), ["l", "bus", "metra"]).select("corridor_id", "mode", "priority", "last_predicted_at")


def f26_enqueued(s: SparkSession, d: str) -> DataFrame:
    return predict.enqueue(proxies.forecasts(s, d).where(F.col("status") == "pending").select("corridor_id", "leave_at", "predictor_version", "p90", "forecast_id")).select("forecast_id", "queue_id", "resolve_after", "status")


def f29_popular_pairs(s: SparkSession, d: str) -> DataFrame:
    existing = proxies.table(s, d, "supplier").select((F.col("s_suppkey") % 10).alias("origin"), (F.col("s_nationkey") % 10).cast("bigint").alias("destination"))
    return predict.popular_pairs(proxies.requests(s, d), existing, F.lit("2024-01-13 00:00:00").cast("timestamp_ntz"), 2)


def f33_training_frame(s: SparkSession, d: str) -> DataFrame:
    frame = training.training_frame(scored(s, d), F.col("p50") - 200, 0.25)
    return frame.select("forecast_id", "hod", "weekday", rounded(F.col("horizon_s")).alias("horizon_s"), rounded(F.col("residual")).alias("residual"))


def f34_time_split(s: SparkSession, d: str) -> DataFrame:
    return training.time_split(training.training_frame(scored(s, d), F.col("p50") - 200, 0.25)).groupBy("is_validation").agg(F.count("*").alias("n"), F.min(F.to_date("leave_at")).cast("string").alias("first_day"), F.max(F.to_date("leave_at")).cast("string").alias("last_day"))


def f35_residual_model(s: SparkSession, d: str) -> DataFrame:
    return training.fit_residual_quantiles(training.training_frame(scored(s, d), F.col("p50") - 200, 0.25), ["horizon_s", "hod"])


def f36_quantile_predictions(s: SparkSession, d: str) -> DataFrame:
    """Forecasts shifted by their line's modelled residuals, in order and never below zero, with coverage of the result."""
    frame = training.training_frame(scored(s, d), F.col("p50") - 200, 0.25)
    rows = training.apply_residual_quantiles(frame, training.fit_residual_quantiles(frame, ["horizon_s", "hod"]), ["horizon_s", "hod"])
    at = lambda q: F.col("p50") + F.element_at("residual_q", F.lit(q))
    ordered = rows.withColumns(dict(zip(("q50", "q80", "q90"), predict.monotone(at(0.5), at(0.8), at(0.9))))).withColumn("actual", F.col("p50") + F.col("residual"))
    return ordered.groupBy("line").agg(F.count("*").alias("n"), *[rounded(share(F.col("actual") <= F.col(c)), 3).alias(f"coverage_{c[1:]}") for c in ("q50", "q80", "q90")])


def g31_readiness(s: SparkSession, d: str) -> DataFrame:
    return training.readiness(scored(s, d))


def g33_ingest_health(s: SparkSession, d: str) -> DataFrame:
    return proxies.polls(s, d).groupBy("endpoint").agg(F.count("*").alias("n_polls"), F.count_if("ok").alias("n_ok"), F.max("responded_at").alias("last_response"))


def g11_live_diagnostic(s: SparkSession, d: str) -> DataFrame:
    rows = proxies.arrivals(s, d).where((F.col("polled_at") <= NOW_COLUMN()) & (seconds_of(NOW_COLUMN()) - seconds_of(F.col("polled_at")) <= 86_400))
    return rows.groupBy("line", "station").agg(F.count("*").alias("n_rows"), F.count_if(F.col("arrival_at") > NOW_COLUMN()).alias("n_future"), F.max("polled_at").alias("last_poll"))


def g27_system_state(s: SparkSession, d: str) -> DataFrame:
    rows = proxies.arrivals(s, d).where((F.col("polled_at") <= NOW_COLUMN()) & (seconds_of(NOW_COLUMN()) - seconds_of(F.col("polled_at")) <= 21_600))
    return rows.groupBy("line").agg(F.count_if("delayed").alias("n_delayed"), F.count_if("fault").alias("n_fault"), F.countDistinct("run").alias("n_runs"))


def g28_run_history(s: SparkSession, d: str) -> DataFrame:
    t = seconds_of(F.col("arrival_at"))
    return proxies.arrivals(s, d).groupBy("line", "run", "station").agg(F.count("*").alias("n"), rounded(F.max(t) - F.min(t), 3).alias("range_s")).where("n >= 2")


def a40_least_recent(s: SparkSession, d: str) -> DataFrame:
    by = proxies.arrivals(s, d).groupBy("line", "station").agg(F.max("polled_at").alias("last_poll"))
    return by.orderBy(F.col("last_poll").asc_nulls_first(), "line", "station").limit(20)


def payloads(s: SparkSession, d: str) -> DataFrame:
    """Arrival payloads as a feed would send them: events of an hour of a line, as JSON text."""
    a = proxies.arrivals(s, d)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    bit = lambda c: F.when(F.col(c), "1").otherwise("0")
    eta = F.struct(
        F.col("station").cast("string").alias("staId"), F.col("event_id").cast("string").alias("stpId"), F.col("run").cast("string").alias("rn"), F.col("line").alias("rt"), text("polled_at").alias("prdt"), text("arrival_at").alias("arrT"),
        bit("approaching").alias("isApp"), bit("delayed").alias("isDly"), bit("fault").alias("isFlt"), bit("scheduled").alias("isSch"), F.col("direction_code").alias("trDr"), F.concat(F.lit("to "), "direction_code").alias("destNm"),
    )
    hour = Window.partitionBy("line", F.date_trunc("hour", "polled_at"))
    # a payload holds 400 events at most; a busy hour has several
    a = a.withColumns({"tmst": F.max("polled_at").over(hour), "part": F.floor((F.row_number().over(hour.orderBy("event_id")) - 1) / 400)})
    by = a.groupBy("line", F.date_trunc("hour", "polled_at").alias("hour"), "part").agg(F.collect_list(eta).alias("eta"), F.max("tmst").alias("tmst"))
    code = F.when(F.hour("hour") == 3, "101").otherwise("0")
    body = F.to_json(F.struct(F.struct(text("tmst").alias("tmst"), code.alias("errCd"), "eta").alias("ctatt")))
    return by.select(F.concat_ws(":", "line", text("hour"), "part").alias("poll_id"), body.alias("body"))


def a1_train_arrivals(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.train_arrivals(payloads(s, d))
    return rows.groupBy("line", "station").agg(F.count("*").alias("n"), F.count_if("approaching").alias("n_approaching"), F.count_if("fault").alias("n_fault"), F.countDistinct("run").alias("n_runs"), rounded(F.sum("eta_s") - F.sum("prediction_age_s"), 3).alias("eta_less_age_s"))


def a34_html_rows(s: SparkSession, d: str) -> DataFrame:
    """List items of each page with their links' texts, drawn out by tag names."""
    return ingest.html_rows(proxies.table(s, d, "pages"), "li", "a").select("page_id", F.col("row").cast("bigint").alias("row"), F.array_join("cells", "|").alias("cells"))


def k2_insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d).select("line", "run", "station", "event_id")
    return sinks.insert_if_absent(a.where("event_id % 3 = 0"), a.where("event_id % 3 <> 0"), ["line", "run", "station"], "event_id")


def k3_overwrite(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d).select("line", "station", "event_id", "run", "delayed")
    return sinks.overwrite(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1"), ["line", "station"], "event_id")


def k4_coalescing_upsert(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d).select("line", "station", "event_id", F.when(F.col("run") % 3 != 0, F.col("run")).alias("run"))
    return sinks.coalescing_upsert(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1"), ["line", "station"], "event_id")


def k5_accumulate(s: SparkSession, d: str) -> DataFrame:
    o = scored(s, d).select("line", "actual", "forecast_id")
    part = lambda r: o.where(F.col("forecast_id") % 2 == r).groupBy("line").agg(F.count("*").alias("n"), F.avg("actual").alias("mean"), F.min("actual").alias("low"), F.max("actual").alias("high"))
    return sinks.accumulate(part(0), part(1), ["line"]).select("line", "n", rounded(F.col("mean")).alias("mean"), "low", "high")


def k10_scrubbed_urls(s: SparkSession, d: str) -> DataFrame:
    pages = proxies.table(s, d, "pages")
    url = F.concat("url", F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("api_key=k"), F.col("page_id"))
    return pages.select("page_id", sinks.scrub_url(url).alias("url"), sinks.content_hash(F.col("html")).alias("content"))


def st1_stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Hourly windows through the streaming plan: those that the watermark has passed, which are final."""
    out = jobs.run_once(jobs.windowed_counts(jobs.read_events(s, f"{d}/event[s].parquet")))
    return out.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


def st2_stream_first_seen(s: SparkSession, d: str) -> DataFrame:
    out = jobs.run_once(jobs.first_seen(jobs.read_events(s, f"{d}/event[s].parquet"), ["event_id"]))
    return out.select("event_id", "user_id", "event_type")


def st9_stream_conformal(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.read_events(s, f"{d}/event[s].parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lit(60.0).alias("raw"), F.col("value").alias("seen"))
    out = jobs.conformal_stream(rows)
    return out.select("key", rounded(F.col("offset_s")).alias("offset_s"), "n", "missed")


FAMILY = (
    f10_wait_forecasts, f11_trip_predictions, f17_shrunk_shift, f18_conformal_offsets, f21_promotions, f24_due_corridors, f26_enqueued, f29_popular_pairs, f33_training_frame, f34_time_split, f35_residual_model, f36_quantile_predictions,
    g11_live_diagnostic, g27_system_state, g28_run_history, g31_readiness, g33_ingest_health, a1_train_arrivals, a34_html_rows, a40_least_recent, k2_insert_if_absent, k3_overwrite, k4_coalescing_upsert, k5_accumulate, k10_scrubbed_urls,
    st1_stream_windows, st2_stream_first_seen, st9_stream_conformal,
)
QUERIES = {f.__name__: f for f in FAMILY}

WAITS = f"""SELECT r.request_id, any_value(r.board) AS station, (list({{'wait': epoch_us(a.arrival_at) - epoch_us(r.leave_at), 'app': a.app}} ORDER BY a.arrival_at) FILTER (WHERE a.arrival_at IS NOT NULL)) AS next
  FROM trip_requests r LEFT JOIN (SELECT line, station, arrival_at, bool_or(approaching) AS app FROM arrivals GROUP BY ALL) a ON a.line = r.line AND a.station = r.board AND {E('a.arrival_at')} - {E('r.leave_at')} BETWEEN 0 AND {WAIT_WINDOW} GROUP BY r.request_id"""
GAPS = """SELECT *, next[1].wait / 1e6 AS w, next IS NOT NULL AS live, station % 2 = 0 AS sched, list_transform(range(2, coalesce(len(next), 0) + 1), lambda i: next[i].wait - next[i - 1].wait) AS gaps FROM waits"""
STATS = "SELECT *, len(gaps) AS ng, list_median(gaps) / 1e6 AS gap, list_median(gaps[2:]) / 1e6 AS rest, gaps[1] / 1e6 AS g1 FROM gapped"
MODEL = """SELECT request_id, CASE WHEN live THEN w WHEN sched THEN 450 ELSE 0 END::DOUBLE AS mean, CASE WHEN live AND ng = 0 THEN greatest(60, 0.2 * w) WHEN live THEN greatest(45, 0.3 * gap) WHEN sched THEN 300 ELSE 0 END::DOUBLE AS sigma,
  CASE WHEN live AND ng = 0 THEN 0.55 WHEN live THEN least(1, 0.5 + 0.1 * least(ng, 4)) WHEN sched THEN 0.4 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN NOT live AND sched THEN 'feed_unreliable' WHEN NOT live THEN 'unknown' WHEN next[1].app OR w <= 240 THEN 'good' WHEN ng >= 2 AND rest > 0 AND g1 > 0 AND g1 < 0.5 * rest AND g1 <= 240 THEN 'bunched'
  WHEN (ng >= 2 AND rest > 0 AND g1 > 2 * rest AND g1 > 720) OR w > 720 THEN 'bad_gap' WHEN w > 420 THEN 'risky' ELSE 'acceptable' END AS state, live, sched, w FROM stats"""
WAIT_OUT = "SELECT request_id, state, round(mean, 4) AS mean, round(sigma, 4) AS sigma, round(confidence, 4) AS confidence, " + ", ".join(
    f"round(CASE WHEN live THEN (w <= {x})::INTEGER WHEN sched THEN 1 - exp(-{x} / 450.0::DOUBLE) ELSE 0 END::DOUBLE, 4) AS p_{x // 60}min" for x in (300, 600, 900)
) + f", round(greatest(0, mean), 4) AS p50, round(greatest(0, mean + {predict.Z80!r}::DOUBLE * sigma), 4) AS p80, round(greatest(0, mean + {predict.Z90!r}::DOUBLE * sigma), 4) AS p90 FROM model"
VIEWS = {"waits": WAITS, "gapped": GAPS, "stats": STATS, "model": MODEL}
NEW_PAIRS = "(SELECT DISTINCT s_suppkey % 10 AS origin, s_nationkey % 10 AS destination FROM supplier)"
FRAME = "SELECT * FROM scored WHERE status = 'resolved' AND actual IS NOT NULL AND coalesce(truth_confidence, 0) >= 0.25 AND p50 - 200 >= 90"
RIDE = "(abs(r.alight - r.board) * 800.0::DOUBLE / 10 + abs(r.alight - r.board) * 800.0::DOUBLE / 1000 * 25)"

def _steps_sql(raw: str, seen: str, order: str) -> str:
    """A key's observations in order, each in the shape of the state that they are folded into."""
    return f"list({{'off': 0::DOUBLE, 'step': 0::DOUBLE, 'n': 0::BIGINT, 'missed': 0::BIGINT, 'raw': {raw}::DOUBLE, 'seen': {seen}::DOUBLE}} ORDER BY {order})"


def _conformal_sql(t: str) -> str:
    """The fold of ``steps``; one-element lists name what is used several times."""
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    error = "(x.seen - x.raw - a.off - s * m)"
    losses = f"list_transform([{', '.join(f'{s}::DOUBLE' for s in online.STEPS)}], lambda s: greatest({t} * {error}, ({t} - 1) * {error}))"
    mass = f"list_transform(ls, lambda v: exp({-online.ETA}::DOUBLE * (v - list_min(ls))))"
    mean = "(" + " + ".join(f"{s}::DOUBLE * u[{i + 1}]" for i, s in enumerate(online.STEPS)) + ") / list_sum(u)"
    state = f"{{'off': greatest({-online.BOUND}::DOUBLE, least({online.BOUND}::DOUBLE, a.off + g * m)), 'step': g, 'n': a.n + 1, 'missed': a.missed + CASE WHEN m > 0 THEN 1 ELSE 0 END, 'raw': x.raw, 'seen': x.seen}}"
    miss = f"CASE WHEN x.seen <= greatest(0, x.raw + a.off) THEN {t} - 1 ELSE {t} END"
    step = let(miss, "m", let(losses, "ls", let(mass, "u", let(mean, "g", state))))
    start = "{'off': 0::DOUBLE, 'step': 0::DOUBLE, 'n': 0::BIGINT, 'missed': 0::BIGINT, 'raw': 0::DOUBLE, 'seen': 0::DOUBLE}"
    return f"list_reduce(list_prepend({start}, steps), lambda a, x: {step})"


ORACLE = {
    "f10_wait_forecasts": sql(WAIT_OUT, "arrivals", "trip_requests", **VIEWS),
    "f11_trip_predictions": sql(f"""SELECT request_id, round(w.p50 + ride, 3) AS p50, round(w.p80 + ride + {predict.Z80!r}::DOUBLE * greatest(60, 0.12::DOUBLE * ride), 3) AS p80, round(w.p90 + ride + {predict.Z90!r}::DOUBLE * greatest(60, 0.12::DOUBLE * ride), 3) AS p90,
      round(least(confidence, 0.7), 4)::DOUBLE AS confidence FROM waits_out w JOIN (SELECT r.request_id, {RIDE} AS ride FROM trip_requests r) USING (request_id)""", "arrivals", "trip_requests", **VIEWS, waits_out=WAIT_OUT),
    "f17_shrunk_shift": sql("SELECT line, direction_code, count(*) AS n, round(avg(p50_residual), 6) AS mean, round(var_pop(p50_residual), 3) AS variance, round(avg(p50_residual) * count(*) / greatest(50, count(*)), 6) AS shift FROM scored WHERE status = 'resolved' GROUP BY ALL", "scored"),
    "f24_due_corridors": sql("""SELECT c.corridor_id, c.mode, c.priority, l.last_predicted_at FROM corridors c LEFT JOIN (SELECT corridor_id, max(leave_at) AS last_predicted_at FROM forecasts WHERE leave_at <= TIMESTAMP '1998-01-01' GROUP BY 1) l USING (corridor_id)
      WHERE c.priority < 2 AND c.mode IN ('l', 'bus', 'metra') AND (l.last_predicted_at IS NULL OR epoch(TIMESTAMP '1998-01-01' - l.last_predicted_at) >= 3600)""", "forecasts", "corridors"),
    "f26_enqueued": sql("""SELECT forecast_id, sha256(corridor_id || '|' || CAST(leave_at AS VARCHAR) || '|' || predictor_version) AS queue_id, make_timestamp(CAST(floor((epoch_us(leave_at) / 1e6 + p90 + 600) * 1000000) AS BIGINT)) AS resolve_after, 'pending' AS status
      FROM forecasts WHERE status = 'pending'""", "forecasts"),
    "f29_popular_pairs": sql(f"""SELECT origin, destination, count(*) AS n FROM requests r WHERE queried_at >= TIMESTAMP '2024-01-13' AND success AND NOT EXISTS (SELECT 1 FROM {NEW_PAIRS} p WHERE p.origin = r.origin AND p.destination = r.destination)
      GROUP BY ALL HAVING count(*) >= 2""", "requests"),
    "f33_training_frame": sql(f"SELECT forecast_id, {HOD}, round(p50 - 200, 6) AS horizon_s, round(p50_residual, 6) AS residual FROM ({FRAME})", "scored"),
    "f34_time_split": sql(f"""SELECT CAST(leave_at AS DATE) >= (SELECT min(day) FROM (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT CAST(leave_at AS DATE) AS day, count(*) AS n FROM frame GROUP BY 1))
      WHERE before >= 0.8 * (SELECT count(*) FROM frame)) AS is_validation, count(*) AS n, CAST(min(CAST(leave_at AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(leave_at AS DATE)) AS VARCHAR) AS last_day FROM frame GROUP BY 1""", "scored", frame=FRAME),
    "g11_live_diagnostic": sql(f"SELECT line, station, count(*) AS n_rows, count(*) FILTER (WHERE arrival_at > TIMESTAMP '{NOW}') AS n_future, max(polled_at) AS last_poll FROM arrivals WHERE polled_at <= TIMESTAMP '{NOW}' AND epoch(TIMESTAMP '{NOW}') - {E('polled_at')} <= 86400 GROUP BY ALL", "arrivals"),
    "g27_system_state": sql(f"SELECT line, count(*) FILTER (WHERE delayed) AS n_delayed, count(*) FILTER (WHERE fault) AS n_fault, count(DISTINCT run) AS n_runs FROM arrivals WHERE polled_at <= TIMESTAMP '{NOW}' AND epoch(TIMESTAMP '{NOW}') - {E('polled_at')} <= 21600 GROUP BY ALL", "arrivals"),
    "g28_run_history": sql(f"SELECT line, run, station, count(*) AS n, round(max({E('arrival_at')}) - min({E('arrival_at')}), 3) AS range_s FROM arrivals GROUP BY ALL HAVING count(*) >= 2", "arrivals"),
    "g31_readiness": sql("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_buckets, count(*) FILTER (WHERE n >= 100) AS n_strong FROM (SELECT count(*) AS n FROM scored WHERE status = 'resolved' GROUP BY line, direction_code)", "scored"),
    "g33_ingest_health": sql("SELECT endpoint, count(*) AS n_polls, count(*) FILTER (WHERE ok) AS n_ok, max(responded_at) AS last_response FROM polls GROUP BY ALL", "polls"),
    "a1_train_arrivals": sql("""SELECT line, station, count(*) AS n, count(*) FILTER (WHERE approaching) AS n_approaching, count(*) FILTER (WHERE fault) AS n_fault, count(DISTINCT run) AS n_runs,
      round(sum(epoch(date_trunc('second', arrival_at)) - 2 * epoch(tmst) + epoch(date_trunc('second', polled_at)))::DOUBLE, 3) AS eta_less_age_s FROM (SELECT *, date_trunc('second', max(polled_at) OVER (PARTITION BY line, date_trunc('hour', polled_at))) AS tmst FROM arrivals)
      WHERE extract(hour FROM polled_at) <> 3 GROUP BY ALL""", "arrivals"),
    "a34_html_rows": r"""SELECT page_id, CAST(i - 1 AS BIGINT) AS row, array_to_string(list_transform(regexp_extract_all(rows_[i], '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), '|') AS cells
      FROM (SELECT page_id, rows_, unnest(range(1, len(rows_) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1) AS rows_ FROM pages))""",
    "a40_least_recent": sql("SELECT line, station, max(polled_at) AS last_poll FROM arrivals GROUP BY ALL ORDER BY last_poll, line, station LIMIT 20", "arrivals"),
    "k2_insert_if_absent": sql("SELECT line, run, station, min(event_id) AS event_id FROM arrivals a WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM arrivals t WHERE t.event_id % 3 = 0 AND t.line = a.line AND t.run = a.run AND t.station = a.station) GROUP BY line, run, station", "arrivals"),
    "k3_overwrite": sql("SELECT line, station, event_id, run, delayed FROM (SELECT *, row_number() OVER (PARTITION BY line, station ORDER BY event_id DESC) AS n FROM arrivals) WHERE n = 1", "arrivals"),
    "k4_coalescing_upsert": sql("SELECT line, station, max(event_id) AS event_id, arg_max(run, event_id) FILTER (WHERE run % 3 <> 0) AS run FROM arrivals GROUP BY line, station", "arrivals"),
    "k5_accumulate": sql("SELECT line, count(*) AS n, round(avg(actual), 6) AS mean, min(actual) AS low, max(actual) AS high FROM scored GROUP BY line", "scored"),
    "k10_scrubbed_urls": "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=<redacted>' AS url, sha256(html) AS content FROM pages",
    "st1_stream_windows": """SELECT start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS start_at FROM events)
      WHERE start_at + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
    "st9_stream_conformal": f"""SELECT key, round(s.off, 6) AS offset_s, s.n AS n, s.missed AS missed FROM (SELECT key, {_conformal_sql('0.8::DOUBLE')} AS s FROM (SELECT event_type AS key,
      {_steps_sql('60.0::DOUBLE', 'value', 'ts, value')} AS steps FROM events WHERE value IS NOT NULL GROUP BY event_type))""",
    "f18_conformal_offsets": sql(f"""SELECT predictor_version, line, round(s.off, 6) AS offset_s, round(s.step, 6) AS step_size, s.n AS n, s.missed AS missed FROM (SELECT predictor_version, line, {_conformal_sql('0.8::DOUBLE')} AS s
      FROM (SELECT predictor_version, line, {_steps_sql('p80', 'actual', 'resolved_at, forecast_id')} AS steps FROM scored WHERE status = 'resolved' AND actual IS NOT NULL GROUP BY ALL))""", "scored"),
    "f21_promotions": sql("""SELECT corridor_id, s.active AS active, s.score AS decided_score, s.pending AS pending, s.streak AS streak, s.changes AS changes FROM (SELECT corridor_id, list_reduce(list_prepend(
      {'active': 'pv0', 'score': NULL::DOUBLE, 'pending': NULL::VARCHAR, 'streak': 0::BIGINT, 'changes': 0::BIGINT, 'c': '', 'v': 0::DOUBLE}, steps), lambda a, x: CASE
      WHEN x.c = a.active THEN {'active': a.active, 'score': x.v, 'pending': NULL, 'streak': 0, 'changes': a.changes, 'c': '', 'v': 0}
      WHEN NOT x.v + 0.005::DOUBLE < coalesce(a.score, 300) THEN {'active': a.active, 'score': coalesce(a.score, 300), 'pending': CASE WHEN a.pending = x.c THEN NULL ELSE a.pending END,
        'streak': CASE WHEN a.pending = x.c THEN 0 ELSE a.streak END, 'changes': a.changes, 'c': '', 'v': 0}
      WHEN coalesce(a.pending = x.c, false) AND a.streak >= 1 THEN {'active': x.c, 'score': x.v, 'pending': NULL, 'streak': 0, 'changes': a.changes + 1, 'c': '', 'v': 0}
      ELSE {'active': a.active, 'score': coalesce(a.score, 300), 'pending': x.c, 'streak': 1, 'changes': a.changes, 'c': '', 'v': 0} END) AS s
      FROM (SELECT corridor_id, list({'active': '', 'score': 0::DOUBLE, 'pending': '', 'streak': 0::BIGINT, 'changes': 0::BIGINT, 'c': predictor_version, 'v': score} ORDER BY day, predictor_version) AS steps
      FROM (SELECT corridor_id, CAST(resolved_at AS DATE) AS day, predictor_version, round(avg(abs(p50_residual)), 6) AS score FROM scored WHERE status = 'resolved' GROUP BY ALL) GROUP BY corridor_id))""", "scored"),
    "st2_stream_first_seen": "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events",
}
