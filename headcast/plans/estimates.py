"""Queries of the estimators. Evidence is joined from the feeds; the SQL repeats the rules from the same fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headcast.functions.geo import haversine_m
from headcast.functions.scores import rounded
from headcast.operators import arrivals as arr
from headcast.operators import estimate as op
from headcast.operators import joins, sinks
from headcast.operators.joins import seconds_of
from headcast.operators.sliding import Spread, micros, over_windows
from headcast.plans import arrivals as arrival_plans
from headcast.plans.arrivals import E, NOW, NOW_COLUMN
from headcast.sources import proxies
from headcast.sources.proxies import sql


#: Added before rounding to hundredths, so that halves that come out a hair apart go the same way.
TIE = 1e-7


#: Microseconds that recent predictions lie back; the test tables have one event in minutes.
RECENT_US = 86_400_000_000


def with_volatility(rows: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``n_recent`` and ``volatility``: how far the predicted times of their key scattered up to their own poll."""
    told = predictions.select(*keys, F.col("polled_at").alias("told_at"), (F.unix_micros(F.col("arrival_at").cast("timestamp")) / 1e6).alias("predicted_s"))
    return over_windows(rows, told, keys, micros(F.col("polled_at")), micros(F.col("told_at")), -RECENT_US, 0, Spread, ["predicted_s"])


def g37_volatility(s: SparkSession, d: str) -> DataFrame:
    """Of each prediction, how far those of its run and stop scattered in the day up to it (interquartile range / 1.349)."""
    rows = with_volatility(proxies.arrivals(s, d).select("event_id", "line", "station", "polled_at"), proxies.arrivals(s, d), ["line", "station"])
    return rows.select("event_id", "n_recent", rounded(F.coalesce("volatility", F.lit(-1.0)), 3).alias("volatility"))


def f13_train_estimates(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the last day before now, with their run's latest position and its latest other prediction."""
    now = seconds_of(NOW_COLUMN())
    a = proxies.arrivals(s, d).where((F.col("polled_at") <= NOW_COLUMN()) & (now - seconds_of(F.col("polled_at")) <= 86_400))
    last = joins.latest_by(proxies.positions(s, d).where(F.col("polled_at") <= NOW_COLUMN()).select("line", "run", "polled_at", "event_id", F.col("station").alias("next_station"), F.col("fault").alias("position_fault")), ["line", "run"], "polled_at", "event_id")
    position = last.select("line", "run", "next_station", "position_fault", F.col("polled_at").alias("position_at"))
    follow = a.groupBy("line", "run", "station").agg(F.max_by(F.struct("arrival_at", "event_id"), F.struct("polled_at", "event_id")).alias("f")).select("line", "run", "station", F.col("f.arrival_at").alias("follow_at"), F.col("f.event_id").alias("follow_id"))
    rows = a.join(position, ["line", "run"], "left").join(follow, ["line", "run", "station"], "left")
    third = joins.latest_by(proxies.arrivals(s, d).where((F.col("event_id") % 4 == 1) & (F.col("polled_at") <= NOW_COLUMN())).select("line", "station", "polled_at", "event_id", F.col("arrival_at").alias("third_at")), ["line", "station"], "polled_at", "event_id")
    rows = rows.join(third.select("line", "station", "third_at"), ["line", "station"], "left")
    rows = with_volatility(rows, proxies.arrivals(s, d), ["line", "run", "station"])
    other = F.when(F.col("follow_id") != F.col("event_id"), F.col("follow_at"))
    evidence = rows.withColumns({
        "prediction_age_s": now - seconds_of(F.col("polled_at")), "position_found": F.col("position_at").isNotNull(), "position_age_s": now - seconds_of(F.col("position_at")), "eta_s": seconds_of(F.col("arrival_at")) - now, "follow_s": seconds_of(other) - now,
        "follow_gap_s": F.abs(seconds_of(other) - seconds_of(F.col("arrival_at"))), "gtfsrt_gap_s": F.abs(seconds_of(F.col("third_at")) - seconds_of(F.col("arrival_at"))), "volatility_s": F.col("volatility"), "downstream": F.when(F.col("next_station") % 7 != 0, F.col("next_station") < F.col("station")),
    })
    out = op.train_estimates(evidence)
    return out.select("event_id", rounded(F.col("reliability"), 4).alias("reliability"), "display", F.array_join("reasons", ",").alias("reasons"), *[rounded(F.col(c), 2).alias(c) for c in ("arrival_s", "low80", "high80", "low95", "high95")])


def f12_bus_estimates(s: SparkSession, d: str) -> DataFrame:
    """Every vehicle observation against the middle stop of its pattern, with its recent course as evidence."""
    v = proxies.vehicles(s, d)
    points = proxies.pattern_points(s, d)
    stop = points.where(F.col("seq") == 3).select("pid", F.col("pdist").alias("stop_pdist"))
    matched = arr.map_match(v.select(F.col("event_id").alias("vehicle_row"), "pid", "lat", "lon", "heading"), points.select("pid", "seq", "lat", "lon", "pdist")).select(F.col("vehicle_row").alias("event_id"), F.col("quality").alias("map_quality"), "projected")
    recent = Window.partitionBy("vid").orderBy("at_s", "event_id").rowsBetween(-4, 0)
    course = v.withColumn("course", F.collect_list("pdist").over(recent))
    rows = course.join(F.broadcast(stop), "pid", "left").join(matched, "event_id", "left")
    n = F.col("event_id")
    evidence = sinks.conform(
        rows.withColumns({
            "vehicle_found": n % 11 != 0, "vehicle_age_s": F.col("age_s"), "prediction_age_s": (n % 200).cast("double"), "dyn": (n % 40).cast("int"), "same_route": n % 5 != 0, "pdist_trend": op.trend(F.col("course"), False),
            "eta_s": (n % 1500).cast("double"), "typ": F.when(n % 2 == 0, "A").otherwise("D"), "speed_ftps": F.when(n % 3 != 0, F.lit(20.0)), "dstp_ft": F.greatest(F.lit(0.0), F.col("stop_pdist") - F.col("pdist")), "delayed": n % 13 == 0, "detour_active": n % 17 == 0,
        }),
        {"event_id": "bigint", **op.BUS_EVIDENCE},
    )
    out = op.bus_estimates(evidence)
    return out.select("event_id", rounded(F.col("reliability"), 4).alias("reliability"), "display", F.array_join("reasons", ",").alias("reasons"), *[rounded(F.col(c) + TIE, 2).alias(c) for c in ("arrival_s", "low80", "high80", "low95", "high95")])


def bus_predictions(s: SparkSession, d: str) -> DataFrame:
    """The feed's predictions: vehicle, pattern and stop, times, and what the payload says."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return proxies.table(s, d, "events").select(
        "event_id", F.col("user_id").alias("vid"), at.alias("at_us"), F.when(k % 6 == 0, (F.col("user_id") + 1) % 5).otherwise(F.col("user_id") % 5).cast("int").alias("route"), (k % 6 + 1).cast("int").alias("seq"), F.floor("value").cast("double").alias("eta_s"),
        F.when(k % 3 != 0, (k % 23).cast("int")).alias("dyn"), (k % 7 == 0).alias("delayed"), F.when(k % 11 == 0, "D").otherwise("A").alias("typ"), F.when(k % 4 != 0, 12.0 * (k % 50)).alias("dstp_ft"), (k % 150).cast("double").alias("prediction_age_s"),
    )


#: Longest time that an observation stands for its vehicle.
KNOWN_S = 172_800


def f12_joined_estimates(s: SparkSession, d: str) -> DataFrame:
    """Every prediction with evidence from the other feeds: the vehicle's last observation, its course, speed and match, the
    stop on the vehicle's pattern, detours of route and stop, and how the predictions before it went."""
    told, points = bus_predictions(s, d), proxies.pattern_points(s, d)
    v = proxies.vehicles(s, d)
    matched = arr.map_match(v.select(F.col("event_id").alias("vehicle_row"), "pid", "lat", "lon", "heading"), points.select("pid", "seq", "lat", "lon", "pdist")).select(F.col("vehicle_row").alias("event_id"), F.col("quality").alias("map_quality"), "projected")
    along = Window.partitionBy("vid").orderBy("at_s", "event_id")
    step, time = F.col("pdist") - F.lag("pdist").over(along), F.col("at_s") - F.lag("at_s").over(along)
    seen = v.join(matched, "event_id", "left").withColumns({"pdist_trend": op.trend(F.collect_list("pdist").over(along.rowsBetween(-4, 0)), False), "speed_ftps": F.when((step > 0) & (time > 0), 1000 * step / time)})
    seen = seen.select("vid", F.col("at_s").alias("seen_s"), F.col("pid").alias("v_pid"), "pdist", "age_s", "lat", "lon", "map_quality", "projected", "pdist_trend", "speed_ftps")
    # an observation of the same moment isn't known yet
    rows = joins.latest_before(told, seen, ["vid"], (F.col("at_us") - 1) / 1e6, F.col("seen_s"))
    found = F.col("latest").isNotNull() & (F.col("at_us") / 1e6 - F.col("latest.seen_s") <= KNOWN_S)
    rows = rows.withColumn("o", F.when(found, F.col("latest"))).drop("latest")
    rows = over_windows(rows, told.select("vid", "seq", F.col("at_us").alias("told_us"), (F.col("at_us") / 1e6 + F.col("eta_s")).alias("predicted_s")), ["vid", "seq"], F.col("at_us"), F.col("told_us"), -10 * RECENT_US, 0, Spread, ["predicted_s"])
    course = Window.partitionBy("vid", "seq").orderBy("at_us", "event_id").rowsBetween(-4, 0)
    rows = rows.withColumn("dstp_trend", op.trend(F.collect_list("dstp_ft").over(course), True, 25.0))
    stops = points.select(F.col("pid").alias("route"), "seq", "stop", F.col("pdist").alias("route_pdist"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
    active = points.where("stop % 6 = 1").select(F.col("pid").alias("route")).distinct().withColumn("on_detour", F.lit(True))
    changed = points.where("stop % 8 in (3, 5)").select(F.col("pid").alias("route"), "seq", (F.col("stop") % 8 == 3).alias("removed"))
    rows = rows.join(stops, ["route", "seq"], "left").join(active, "route", "left").join(changed, ["route", "seq"], "left")
    here = F.col("o").isNotNull()
    own = here & (F.col("o.v_pid") == F.col("route"))
    evidence = rows.withColumns({
        "vehicle_found": here, "vehicle_age_s": F.col("o.age_s"), "same_route": F.when(here, own), "stop_pdist": F.when(own, F.col("route_pdist")), "pdist": F.col("o.pdist"), "projected": F.col("o.projected"), "map_quality": F.col("o.map_quality"),
        "pdist_trend": F.col("o.pdist_trend"), "speed_ftps": F.col("o.speed_ftps"), "distance_stop_m": rounded(haversine_m(F.col("o.lat"), F.col("o.lon"), F.col("stop_lat"), F.col("stop_lon")), 3), "volatility_s": F.col("volatility"),
        "detour_active": F.coalesce("on_detour", F.lit(False)), "stop_removed": F.coalesce("removed", F.lit(False)), "stop_added": F.coalesce(~F.col("removed"), F.lit(False)), "flagstop": F.lit(None).cast("int"),
    })
    out = op.bus_estimates(sinks.conform(evidence, {"event_id": "bigint", **op.BUS_EVIDENCE}))
    return out.select("event_id", rounded(F.col("reliability"), 4).alias("reliability"), "display", F.array_join("reasons", ",").alias("reasons"), *[rounded(F.col(c) + TIE, 2).alias(c) for c in ("arrival_s", "low80", "high80", "low95", "high95")])


QUERIES = {f.__name__: f for f in (f12_bus_estimates, f12_joined_estimates, f13_train_estimates, g37_volatility)}


def _rule_sql(rules, start: float) -> str:
    when = lambda r: f"coalesce({r.when.replace('int(', '(').replace('coalesce(approaching, false)', 'coalesce(approaching, false)::INT').replace('<= 30, false)', '<= 30, false)::INT').replace('<= 45, false)', '<= 45, false)::INT') if 'int(' in r.when else r.when}, false)"
    score = " + ".join([f"{start}::DOUBLE", *[f"CASE WHEN {when(r)} THEN {r.delta}::DOUBLE ELSE 0 END" for r in rules if r.delta]])
    reasons = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {when(r)} THEN '{r.reason}' END" for r in rules if r.reason) + "], lambda x: x IS NOT NULL)))"
    abstain = " OR ".join(when(r) for r in rules if r.abstain)
    return f"greatest(0, least(1, {score})) AS rel, {reasons} AS reasons, {abstain} AS abstain"


def _scatter_sql(keys: str) -> str:
    return f"""SELECT event_id, n AS n_recent, CASE WHEN n >= 3 THEN abs(hi - lo) / 1.349 END AS volatility FROM (SELECT event_id, count(*) OVER w AS n, quantile_cont(epoch_us(arrival_at) / 1e6, 0.75) OVER w AS hi, quantile_cont(epoch_us(arrival_at) / 1e6, 0.25) OVER w AS lo
      FROM arrivals WINDOW w AS (PARTITION BY {keys} ORDER BY epoch_us(polled_at) RANGE BETWEEN {RECENT_US} PRECEDING AND CURRENT ROW))"""


NOW_S = f"epoch(TIMESTAMP '{NOW}')"
#: The map match is the one of the arrival family: its views, without what goes around them.
MATCHED = arrival_plans.ORACLE["f6_map_match"].removeprefix("WITH ")
MATCH_VIEWS, MATCH_BODY = MATCHED[: MATCHED.index("SELECT event_id AS vehicle_row")].rstrip(), MATCHED[MATCHED.index("SELECT event_id AS vehicle_row") :]
BUS_SCORE = _rule_sql(op.BUS_RULES, op.BUS_START).replace("greatest(0, least(1, ", "(", 1).replace(")) AS rel", ") AS score", 1)
PLUS = "coalesce(greatest(0, {} - 30) * {}, 0)".format
#: From the evidence to the estimate.
BUS_TAIL = f"""judged AS (SELECT *, {BUS_SCORE} FROM evidence),
      placed AS (SELECT *, abs(eta_s - geo) AS gap FROM (SELECT *, CASE WHEN vehicle_found AND stop_pdist - pdist >= 0 THEN CASE WHEN speed_ftps IS NOT NULL THEN (stop_pdist - pdist) / greatest(speed_ftps, 0.1::DOUBLE) ELSE dstp_ft / 18 END END AS geo FROM judged)),
      blended AS (SELECT *, CASE WHEN abstain THEN NULL ELSE greatest(0, CASE WHEN gap <= 75 THEN 0.68::DOUBLE * eta_s + 0.32::DOUBLE * geo WHEN gap IS NOT NULL THEN w * eta_s + (1 - w) * geo ELSE coalesce(eta_s, geo) END) END AS t,
        greatest(0, least(1, score + CASE WHEN abstain THEN 0 WHEN gap <= 75 THEN 0.08::DOUBLE WHEN gap IS NOT NULL THEN -least(0.28::DOUBLE, gap / 600) WHEN vehicle_found THEN -0.02::DOUBLE ELSE -0.06::DOUBLE END)) AS rel
        FROM (SELECT *, CASE WHEN eta_s <= 90 AND geo > 180 THEN 0.25::DOUBLE WHEN prediction_age_s > 60 THEN 0.35::DOUBLE WHEN speed_ftps IS NULL THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS w FROM placed)),
      ready AS (SELECT *, greatest(25, least(600, (28 + 0.12::DOUBLE * t + {PLUS('vehicle_age_s', '0.35::DOUBLE')} + {PLUS('prediction_age_s', '0.25::DOUBLE')} + CASE WHEN gap IS NOT NULL THEN least(180, 0.35::DOUBLE * gap) ELSE 0 END + CASE WHEN volatility_s IS NOT NULL THEN least(120, 0.45::DOUBLE * volatility_s) ELSE 0 END + CASE WHEN detour_active THEN 60 ELSE 0 END) * (1 + greatest(0, 0.75::DOUBLE - rel)))) AS half,
        list_sort(list_distinct(list_concat(reasons, CASE WHEN abstain OR gap IS NULL THEN [] WHEN gap <= 75 THEN ['FEED_GEOMETRY_AGREE'] ELSE ['FEED_GEOMETRY_DISAGREE'] END))) AS every FROM blended)
      SELECT event_id, round(rel, 4) AS reliability, CASE WHEN abstain THEN 'do_not_display' WHEN rel >= 0.82 THEN 'high' WHEN rel >= 0.62 THEN 'medium' WHEN rel >= 0.4 THEN 'low' ELSE 'unreliable' END AS display, array_to_string(every, ',') AS reasons, round(t + {TIE}, 2) AS arrival_s,
      round(CASE WHEN t IS NOT NULL THEN t - half END + {TIE}, 2) AS low80, round(CASE WHEN t IS NOT NULL THEN t + half END + {TIE}, 2) AS high80, round(CASE WHEN t IS NOT NULL THEN t - 2.05::DOUBLE * half END + {TIE}, 2) AS low95, round(CASE WHEN t IS NOT NULL THEN t + 2.05::DOUBLE * half END + {TIE}, 2) AS high95 FROM ready"""
TREND = """CASE WHEN len({c}) < 3 THEN 'unknown' WHEN len(list_filter(range(2, len({c}) + 1), lambda i: {s}({c}[i] - {c}[i - 1]) < -{t})) > len(list_filter(range(2, len({c}) + 1), lambda i: {s}({c}[i] - {c}[i - 1]) > {t})) THEN 'nonmonotone'
  WHEN len(list_filter(range(2, len({c}) + 1), lambda i: {s}({c}[i] - {c}[i - 1]) > {t})) = 0 THEN 'stalled' ELSE 'monotone' END""".format
JOINED = f"""WITH {MATCH_VIEWS}, matched AS ({MATCH_BODY.replace("round(pdist1 + t * (pdist2 - pdist1), 3) AS projected", "pdist1 + t * (pdist2 - pdist1) AS projected")}),
  told AS (SELECT event_id, user_id AS vid, epoch_us(ts) AS at_us, CAST(CASE WHEN k % 6 = 0 THEN (user_id + 1) % 5 ELSE user_id % 5 END AS INTEGER) AS route, CAST(k % 6 + 1 AS INTEGER) AS seq, CAST(floor(value) AS DOUBLE) AS eta_s, CASE WHEN k % 3 <> 0 THEN k % 23 END AS dyn,
    k % 7 = 0 AS delayed, CASE WHEN k % 11 = 0 THEN 'D' ELSE 'A' END AS typ, CASE WHEN k % 4 <> 0 THEN 12.0::DOUBLE * (k % 50) END AS dstp_ft, CAST(k % 150 AS DOUBLE) AS prediction_age_s FROM k_events),
  course AS (SELECT *, list(pdist) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c, CASE WHEN pdist - lag(pdist) OVER w > 0 AND at_s - lag(at_s) OVER w > 0 THEN 1000 * (pdist - lag(pdist) OVER w) / (at_s - lag(at_s) OVER w) END AS speed FROM vehicles WINDOW w AS (PARTITION BY vid ORDER BY at_s, event_id)),
  seen AS (SELECT c.*, m.quality, m.projected, {TREND(c="c", s="", t="1")} AS trend FROM course c LEFT JOIN matched m ON m.vehicle_row = c.event_id),
  recent AS (SELECT *, list(dstp_ft) FILTER (WHERE dstp_ft IS NOT NULL) OVER (PARTITION BY vid, seq ORDER BY at_us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS dl, count(*) OVER w AS nr, quantile_cont(at_us / 1e6 + eta_s, 0.75) OVER w AS hi, quantile_cont(at_us / 1e6 + eta_s, 0.25) OVER w AS lo
    FROM told WINDOW w AS (PARTITION BY vid, seq ORDER BY at_us RANGE BETWEEN {10 * RECENT_US} PRECEDING AND CURRENT ROW)),
  near AS (SELECT r.*, v.at_s AS seen_s, v.vid IS NOT NULL AND r.at_us / 1e6 - v.at_s <= {KNOWN_S} AS found, v.pid AS v_pid, v.pdist AS v_pdist, v.age_s, v.lat, v.lon, v.quality, v.projected AS v_projected, v.trend, v.speed
    FROM recent r ASOF LEFT JOIN seen v ON v.vid = r.vid AND v.at_s <= (r.at_us - 1) / 1e6),
  evidence AS (SELECT n.event_id, n.prediction_age_s, n.dyn, n.delayed, n.typ, n.dstp_ft, n.eta_s, n.found AS vehicle_found, CASE WHEN found THEN age_s END AS vehicle_age_s, CASE WHEN found THEN v_pid = n.route END AS same_route, CASE WHEN found AND v_pid = n.route THEN p.pdist END AS stop_pdist,
    CASE WHEN found THEN v_pdist END AS pdist, CASE WHEN found THEN v_projected END AS projected, CASE WHEN found THEN quality END AS map_quality, CASE WHEN found THEN trend END AS pdist_trend, CASE WHEN found THEN speed END AS speed_ftps,
    CASE WHEN found THEN round(2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)), 3) END AS distance_stop_m, CASE WHEN nr >= 3 THEN abs(hi - lo) / 1.349 END AS volatility_s, CASE WHEN dl IS NULL THEN 'unknown' ELSE {TREND(c="dl", s="-", t="25")} END AS dstp_trend,
    n.route IN (SELECT pid FROM pattern_points WHERE stop % 6 = 1) AS detour_active, coalesce(p.stop % 8 = 3, false) AS stop_removed, coalesce(p.stop % 8 = 5, false) AS stop_added, NULL::INTEGER AS flagstop
    FROM (SELECT n.*, p.pdist AS pp, sin(radians(p.lat - n.lat) / 2) ** 2 + cos(radians(n.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - n.lon) / 2) ** 2 AS h FROM near n LEFT JOIN pattern_points p ON p.pid = n.route AND p.seq = n.seq) n LEFT JOIN pattern_points p ON p.pid = n.route AND p.seq = n.seq),
      {BUS_TAIL}"""
ORACLE = {
    "g37_volatility": sql(f"SELECT event_id, CAST(n_recent AS INTEGER) AS n_recent, round(coalesce(volatility, -1.0), 3) AS volatility FROM ({_scatter_sql('line, station')})", "arrivals"),
    "f12_bus_estimates": f"""WITH {MATCH_VIEWS}, matched AS ({MATCH_BODY.replace("round(pdist1 + t * (pdist2 - pdist1), 3) AS projected", "pdist1 + t * (pdist2 - pdist1) AS projected")}),
      course AS (SELECT *, list(pdist) OVER (PARTITION BY vid ORDER BY at_s, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM vehicles),
      evidence AS (SELECT v.event_id, v.event_id % 11 <> 0 AS vehicle_found, v.age_s AS vehicle_age_s, (v.event_id % 200)::DOUBLE AS prediction_age_s, v.event_id % 40 AS dyn, v.event_id % 5 <> 0 AS same_route, (v.event_id % 1500)::DOUBLE AS eta_s,
        CASE WHEN v.event_id % 2 = 0 THEN 'A' ELSE 'D' END AS typ, CASE WHEN v.event_id % 3 <> 0 THEN 20.0::DOUBLE END AS speed_ftps, s.pdist AS stop_pdist, v.pdist, greatest(0, s.pdist - v.pdist)::DOUBLE AS dstp_ft, v.event_id % 13 = 0 AS delayed, v.event_id % 17 = 0 AS detour_active,
        m.quality AS map_quality, m.projected, NULL::INTEGER AS flagstop, NULL::BOOLEAN AS stop_removed, NULL::BOOLEAN AS stop_added, NULL::DOUBLE AS distance_stop_m, NULL::VARCHAR AS dstp_trend, NULL::DOUBLE AS volatility_s,
        CASE WHEN len(c) < 3 THEN 'unknown' WHEN len(list_filter(range(2, len(c) + 1), lambda i: c[i] - c[i - 1] < -1)) > len(list_filter(range(2, len(c) + 1), lambda i: c[i] - c[i - 1] > 1)) THEN 'nonmonotone'
          WHEN len(list_filter(range(2, len(c) + 1), lambda i: c[i] - c[i - 1] > 1)) = 0 THEN 'stalled' ELSE 'monotone' END AS pdist_trend
        FROM course v LEFT JOIN (SELECT pid, pdist FROM pattern_points WHERE seq = 3) s ON s.pid = v.pid LEFT JOIN matched m ON m.vehicle_row = v.event_id),
{BUS_TAIL}""",
    "f12_joined_estimates": JOINED,
    "f13_train_estimates": sql(
        """SELECT event_id, round(rel, 4) AS reliability, CASE WHEN abstain THEN 'do_not_display' WHEN rel >= 0.82 THEN 'high' WHEN rel >= 0.62 THEN 'medium' WHEN rel >= 0.4 THEN 'low' ELSE 'unreliable' END AS display, array_to_string(reasons, ',') AS reasons,
        round(t, 2) AS arrival_s, round(t - h, 2) AS low80, round(t + h, 2) AS high80, round(t - 2.05::DOUBLE * h, 2) AS low95, round(t + 2.05::DOUBLE * h, 2) AS high95 FROM (SELECT *, greatest(20, least(480, (25.0::DOUBLE + 0.1::DOUBLE * greatest(0, t)
        + coalesce(greatest(0, prediction_age_s - 30) * 0.25::DOUBLE, 0) + coalesce(greatest(0, position_age_s - 30) * 0.2::DOUBLE, 0)) * (1 + greatest(0, 0.75::DOUBLE - rel)))) AS h FROM (SELECT *, CASE WHEN NOT abstain THEN CASE WHEN follow_s IS NOT NULL
        THEN 0.7::DOUBLE * eta_s + 0.3::DOUBLE * follow_s ELSE eta_s END END AS t FROM judged))""",
        "arrivals", "positions",
        recent=f"SELECT * FROM arrivals WHERE polled_at <= TIMESTAMP '{NOW}' AND {NOW_S} - {E('polled_at')} <= 86400",
        pos=f"SELECT line, run, station AS next_station, fault AS position_fault, polled_at AS position_at FROM (SELECT *, row_number() OVER (PARTITION BY line, run ORDER BY polled_at DESC, event_id DESC) AS n FROM positions WHERE polled_at <= TIMESTAMP '{NOW}') WHERE n = 1",
        fol="SELECT line, run, station, arrival_at AS follow_at, event_id AS follow_id FROM (SELECT *, row_number() OVER (PARTITION BY line, run, station ORDER BY polled_at DESC, event_id DESC) AS n FROM recent) WHERE n = 1",
        third=f"SELECT line, station, arrival_at AS third_at FROM (SELECT *, row_number() OVER (PARTITION BY line, station ORDER BY polled_at DESC, event_id DESC) AS n FROM arrivals WHERE event_id % 4 = 1 AND polled_at <= TIMESTAMP '{NOW}') WHERE n = 1",
        scatter=_scatter_sql("line, run, station"),
        evidence=f"""SELECT a.*, p.next_station, p.position_fault, {NOW_S} - {E('a.polled_at')} AS prediction_age_s, p.position_at IS NOT NULL AS position_found, {NOW_S} - {E('p.position_at')} AS position_age_s, {E('a.arrival_at')} - {NOW_S} AS eta_s,
        CASE WHEN f.follow_id <> a.event_id THEN {E('f.follow_at')} - {NOW_S} END AS follow_s, CASE WHEN f.follow_id <> a.event_id THEN abs({E('f.follow_at')} - {E('a.arrival_at')}) END AS follow_gap_s, abs({E('t.third_at')} - {E('a.arrival_at')}) AS gtfsrt_gap_s, w.volatility AS volatility_s,
        CASE WHEN p.next_station % 7 <> 0 THEN p.next_station < a.station END AS downstream FROM recent a LEFT JOIN pos p USING (line, run) LEFT JOIN fol f USING (line, run, station) LEFT JOIN third t USING (line, station) LEFT JOIN scatter w USING (event_id)""",
        judged=f"SELECT *, {_rule_sql(op.TRAIN_RULES, op.TRAIN_START)} FROM evidence",
    ),
}
