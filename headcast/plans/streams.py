"""Streaming queries over replayed tables, each beside the SQL over the rows that the watermark let through.

Events are replayed in four micro-batches of eight days. Some rows come one batch late, some two; of these the older ones lie
behind the watermark and are dropped. A batch drops what lies at or before the watermark of the batch before it (the newest time
seen up to two batches ago, less the delay); the end gives out what the last watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions.scores import rounded
from headcast.plans import predictions
from headcast.plans.calibration import scored
from headcast.sources import proxies, tail
from headcast.sources.proxies import sql
from headcast.streaming import jobs, stateful
from headcast.streaming.replay import as_stream, fresh_folder, newest, run_through

#: Seconds: apart that samples of one stay may be, and the watermark's delay.
STAY_S, LATE_S = 43_200, 172_800
LATE = f"{LATE_S} seconds"
START = "2024-01-01 00:00:00"


def batch_of(at: str, number: str) -> Column:
    """Which micro-batch an event comes in: its own, one later for some numbers, two later for others."""
    own = F.floor((F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lit(START).cast("timestamp"))) / 691_200)
    delay = F.when(F.col(number) % 17 == 3, 2).when(F.col(number) % 13 == 5, 1).otherwise(0)
    return F.least(own + delay, F.lit(3))


def st2_settled_arrivals(s: SparkSession, d: str) -> DataFrame:
    """Arrivals given out once, when nothing can join their stay any more."""
    told, seen = proxies.arrivals(s, d), proxies.positions(s, d)
    told = as_stream(told, batch_of("polled_at", "event_id"))
    seen = as_stream(seen, batch_of("polled_at", "event_id"))
    return run_through(stateful.settled_arrivals(told, seen, STAY_S, LATE)).rows.drop("batch")


def asked_at_stops(s: SparkSession, d: str) -> DataFrame:
    """Forecasts at stops: every third event, due ten minutes to an hour later."""
    rows = proxies.trip_requests(s, d).where("request_id % 3 = 0").select("request_id", "line", F.col("board").alias("station"), "leave_at")
    return rows.withColumn("resolve_after", F.col("leave_at") + F.make_dt_interval(mins=(10 + F.col("request_id") % 51).cast("int"), hours=F.col("station").cast("int")))


def came_to_stops(s: SparkSession, d: str) -> DataFrame:
    return proxies.arrivals(s, d).where("event_id % 2 = 0").select("event_id", "line", "station", F.col("polled_at").alias("arrived_at"))


def st5_settled_stream(s: SparkSession, d: str) -> DataFrame:
    """Pending forecasts that arrivals resolve, and those whose timer ran out."""
    asked = as_stream(asked_at_stops(s, d), batch_of("leave_at", "request_id"))
    came = as_stream(came_to_stops(s, d), batch_of("arrived_at", "event_id"))
    rows = run_through(stateful.settled_forecasts(asked, came, 300, LATE)).rows
    return rows.select("line", "station", "request_id", "status", "settled_us", (F.col("wait_us") / 1e6).alias("wait_s"))


def st6_interval_join(s: SparkSession, d: str) -> DataFrame:
    """Forecasts with the arrivals of the two hours after them; those that none came for are given out without."""
    key = F.concat_ws(":", "line", F.col("station").cast("string"))
    asked = asked_at_stops(s, d).select("request_id", key.alias("key"), F.col("leave_at").cast("timestamp").alias("leave_at"))
    came = came_to_stops(s, d).select("event_id", key.alias("a_key"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    asked, came = as_stream(asked, batch_of("leave_at", "request_id")), as_stream(came, batch_of("arrived_at", "event_id"))
    met = run_through(stateful.met_forecasts(asked, came, 7200, LATE)).rows
    return met.select("request_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.timestamp_seconds(F.floor(F.col("leave_us") / 1_000_000)).cast("timestamp_ntz").alias("leave_at"))


def st7_sliding_counts(s: SparkSession, d: str) -> DataFrame:
    """Delays and faults per line in half hours that begin every five minutes."""
    polled = as_stream(proxies.arrivals(s, d).select("event_id", "line", "polled_at", "delayed", "fault"), batch_of("polled_at", "event_id"))
    ran = run_through(jobs.sliding_counts(polled, "30 minutes", "5 minutes", LATE))
    return ran.rows.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "line", "n_polls", "n_delayed", "n_fault")


def st9_kept_conformal(s: SparkSession, d: str) -> DataFrame:
    """Conformal offsets in the state store, over four batches in order of time."""
    rows = scored(s, d).where(F.col("status") == "resolved").select(F.concat_ws("|", "predictor_version", "line").alias("key"), F.col("p80").alias("raw"), F.col("actual").alias("seen"), "resolved_at", "forecast_id")
    states = run_through(stateful.kept_conformal(as_stream(rows, years("resolved_at")), ["resolved_at", "forecast_id"]), "update")
    parts = F.split("key", "\\|")
    out = newest(states.rows, ["key"])
    return out.select(parts[0].alias("predictor_version"), parts[1].alias("line"), rounded(F.col("offset_s")).alias("offset_s"), rounded(F.col("step_size")).alias("step_size"), "n", "missed")


def years(at: str) -> Column:
    """Two years to a batch."""
    return F.floor((F.year(at) - 1992) / 2)


def st10_kept_promotions(s: SparkSession, d: str) -> DataFrame:
    """Promotion streaks in the state store, over four batches in order of time."""
    rows = predictions.evaluations(s, d)
    return newest(run_through(stateful.kept_promotions(as_stream(rows, years("at")), "pv0"), "update").rows, ["corridor_id"])


def st16_rolling_promotion(s: SparkSession, d: str) -> DataFrame:
    """Pairs popular in any seven days become corridors, as the batches come in; a repeated batch adds nothing."""
    asked = as_stream(proxies.requests(s, d), batch_of("queried_at", "query_id"))
    made = jobs.rolling_promotions(asked, least=4, late="30 days")
    return made.select("origin", "destination")


def written_logs(s: SparkSession, d: str, upto: int, since: int = 0) -> DataFrame:
    """Lines of four servers' query logs: batches ``since`` to ``upto``, some records repeated, some lines broken."""
    rows = proxies.requests(s, d).withColumn("b", F.floor((F.unix_seconds(F.col("queried_at").cast("timestamp")) - F.unix_seconds(F.lit(START).cast("timestamp"))) / 691_200))
    record = F.to_json(F.struct(
        F.concat(F.lit("q"), "query_id").alias("query_id"), F.date_format("queried_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("queried_at"), F.lit("L").alias("mode"),
        F.concat(F.lit("R"), F.col("origin") % 3).alias("line"), F.col("origin").alias("boarding_int_id"), F.when(F.col("destination") > 0, F.col("destination")).alias("alighting_int_id"), "success",
        F.when(F.col("success"), F.col("query_id") / 4).alias("predicted_wait_p50"),
    ))
    copies = F.when(F.col("query_id") % 7 == 0, F.array(record, record)).when(F.col("query_id") % 11 == 0, F.array(F.lit('{"query_id": "broken'), record)).otherwise(F.array(record))
    # a batch before the first of a rotated log shows some of its records again
    shown = F.col("b").between(since, upto) | ((F.col("b") == since - 1) & (F.col("query_id") % 5 == 0))
    return rows.where(shown).select((F.col("query_id") % 4).alias("server"), "query_id", F.posexplode(copies).alias("nth", "value"))


def st11_query_log(s: SparkSession, d: str) -> DataFrame:
    """Logs of four servers, imported, grown, imported again from where it stopped, rotated, and imported once more."""
    logs, keep = fresh_folder(s, "logs"), fresh_folder(s, "import")
    for upto, since in ((0, 0), (1, 0), (3, 2)):
        replace_logs(written_logs(s, d, upto, since), logs)
        ran = run_through(tail.query_log(s, logs), checkpoint=f"{keep}/state", out=f"{keep}/out")
    rows = ran.rows
    return rows.select("query_id", F.col("queried_at").cast("timestamp_ntz").alias("queried_at"), "mode", "line", "boarding_int_id", "alighting_int_id", "success", rounded(F.coalesce("predicted_wait_p50", F.lit(-1.0))).alias("predicted_wait_p50"))


def replace_logs(lines: DataFrame, folder: str) -> None:
    """Writes each server's lines, in order, as its one log file (``server-N.ndjson``), in place of the one before."""
    spark, fresh = lines.sparkSession, fresh_folder(lines.sparkSession, "written")
    lines.repartition("server").sortWithinPartitions("server", "query_id", "nth").select("server", "value").write.partitionBy("server").text(fresh)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for part in fs.globStatus(path(f"{fresh}/server=*/part-*")):
        log = path(folder, f"server-{part.getPath().getParent().getName()[7:]}.ndjson")
        fs.delete(log, False)
        fs.rename(part.getPath(), log)


QUERIES = {f.__name__: f for f in (
    st2_settled_arrivals, st5_settled_stream, st6_interval_join, st7_sliding_counts, st9_kept_conformal, st10_kept_promotions,
    st11_query_log, st16_rolling_promotion,
)}

BATCH = """least(CAST(floor((epoch({at}) - epoch(TIMESTAMP '2024-01-01')) / 691200) AS BIGINT) + CASE WHEN {n} % 17 = 3 THEN 2 WHEN {n} % 13 = 5 THEN 1 ELSE 0 END, 3)"""
LATE_MS = LATE_S * 1000


def seen_through(rows: str) -> str:
    """Of ``rows`` (b, us: batch and time) for each batch the watermark that its late rows are held against, in milliseconds."""
    return f"SELECT b.b, (SELECT max(us) // 1000 - {LATE_MS} FROM {rows} r WHERE r.b <= b.b - 2) AS w FROM range(4) b(b)"


def last_mark(rows: str) -> str:
    return f"(SELECT max(us) // 1000 - {LATE_MS} FROM {rows})"


def _pick(value: str, order: str, cond: str) -> str:
    return f"arg_max({value}, ({order})) FILTER (WHERE {cond})"


STAYS_SQL = sql(
    f"""SELECT line, run, station, coalesce(p1, p2, p3) AS observed_us, CASE WHEN p1 IS NOT NULL THEN 'positions:approaching' WHEN p2 IS NOT NULL THEN 'arrivals:approaching' ELSE 'arrivals:dropoff' END AS inferred_from,
      coalesce(d0, d1) AS direction_code, first_seen_us, last_seen_us, sample_count FROM (SELECT line, run, station, g, max(us) FILTER (WHERE a = 0 AND approaching) AS p1, {_pick('au', 'us, au', 'a = 1 AND approaching')} AS p2,
      {_pick('au', 'us, au', f'a = 1 AND au <= us + {STAY_S * 1_000_000}')} AS p3, {_pick('direction_code', 'us, direction_code', 'a = 0')} AS d0, {_pick('direction_code', 'us, au, direction_code', 'a = 1')} AS d1,
      min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS sample_count FROM islands GROUP BY ALL)
      WHERE coalesce(p1, p2, p3) IS NOT NULL AND -((-(last_seen_us + {STAY_S * 1_000_000})) // 1000) <= {last_mark('samples')}""",
    "arrivals", "positions",
    samples=f"""SELECT line, run, station, epoch_us(polled_at) AS us, epoch_us(arrival_at) AS au, approaching, direction_code, 1 AS a, {BATCH.format(at='polled_at', n='event_id')} AS b FROM arrivals WHERE NOT fault
      UNION ALL SELECT line, run, station, epoch_us(polled_at), NULL, approaching, direction_code, 0, {BATCH.format(at='polled_at', n='event_id')} FROM positions""",
    marks=seen_through("samples"),
    kept="SELECT s.* FROM samples s JOIN marks m USING (b) WHERE m.w IS NULL OR s.us > m.w * 1000",
    islands=f"""SELECT *, sum(fresh) OVER (PARTITION BY line, run, station ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM
      (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY line, run, station ORDER BY us) <= {STAY_S * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM kept)""",
)
ASKED_SQL = f"""SELECT request_id, line, board AS station, epoch_us(leave_at) AS us, epoch_us(leave_at) + (10 + request_id % 51) * 60000000 + board * 3600000000 AS due, {BATCH.format(at='leave_at', n='request_id')} AS b FROM trip_requests WHERE request_id % 3 = 0"""
CAME_SQL = f"""SELECT event_id, line, station, epoch_us(polled_at) AS us, {BATCH.format(at='polled_at', n='event_id')} AS b FROM arrivals WHERE event_id % 2 = 0"""
KEPT = {
    "asked_kept": "SELECT a.* FROM asked a JOIN marks m USING (b) WHERE m.w IS NULL OR a.us > m.w * 1000",
    "came_kept": "SELECT c.* FROM came c JOIN marks m USING (b) WHERE m.w IS NULL OR c.us > m.w * 1000",
}
SETTLED_SQL = sql(
    f"""SELECT line, station, request_id, CASE WHEN first IS NULL THEN 'unresolvable' ELSE 'resolved' END AS status, CASE WHEN first IS NULL THEN due + 300000000 ELSE greatest(due, first) END AS settled_us, (first - us) / 1e6 AS wait_s
      FROM (SELECT a.*, (SELECT min(c.us) FROM came_kept c WHERE c.line = a.line AND c.station = a.station AND c.us BETWEEN a.us AND a.due + 300000000) AS first FROM asked_kept a)
      WHERE -((-(due + 300000000)) // 1000) <= {last_mark('each_row')}""",
    "arrivals", "trip_requests", asked=ASKED_SQL, came=CAME_SQL, each_row="SELECT b, us FROM asked UNION ALL SELECT b, us FROM came", marks=seen_through("each_row"), **KEPT,
)
#: Each side has its own watermark; the lesser holds for both.
JOIN_SQL = sql(
    f"""SELECT a.request_id, c.event_id, date_trunc('second', make_timestamp(a.us)) AS leave_at FROM asked_kept a JOIN came_kept c ON c.line = a.line AND c.station = a.station AND c.us BETWEEN a.us AND a.us + 7200000000
      UNION ALL SELECT a.request_id, -1, date_trunc('second', make_timestamp(a.us)) FROM asked_kept a WHERE NOT EXISTS (SELECT 1 FROM came_kept c WHERE c.line = a.line AND c.station = a.station AND c.us BETWEEN a.us AND a.us + 7200000000)
      AND a.us + 7200000000 < 1000 * least({last_mark('asked')}, {last_mark('came')})""",
    "arrivals", "trip_requests", asked=ASKED_SQL, came=CAME_SQL,
    marks=f"SELECT b, least(x.w, y.w) AS w FROM ({seen_through('asked')}) x JOIN ({seen_through('came')}) y USING (b)", **KEPT,
)
SLIDING_SQL = sql(
    f"""SELECT make_timestamp(start) AS start_at, line, count(*) AS n_polls, count(*) FILTER (WHERE delayed) AS n_delayed, count(*) FILTER (WHERE fault) AS n_fault
      FROM (SELECT p.*, (us // 300000000 - k) * 300000000 AS start FROM polled p, range(6) r(k)) z JOIN marks m USING (b)
      WHERE (m.w IS NULL OR start + 1800000000 > m.w * 1000) AND start + 1800000000 <= 1000 * {last_mark('polled')} GROUP BY ALL""",
    "arrivals", polled=f"SELECT event_id, line, epoch_us(polled_at) AS us, delayed, fault, {BATCH.format(at='polled_at', n='event_id')} AS b FROM arrivals", marks=seen_through("polled"),
)
ROLLING_SQL = sql(
    """SELECT DISTINCT origin, destination FROM (SELECT origin, destination, day - k AS start, count(*) AS n FROM (SELECT *, epoch_us(queried_at) // 86400000000 AS day FROM requests WHERE success), range(7) r(k) GROUP BY ALL) WHERE n >= 4""",
    "requests",
)
ORACLE = {
    "st2_settled_arrivals": STAYS_SQL,
    "st5_settled_stream": SETTLED_SQL,
    "st6_interval_join": JOIN_SQL,
    "st7_sliding_counts": SLIDING_SQL,
    "st9_kept_conformal": predictions.ORACLE["f18_conformal_offsets"],
    "st10_kept_promotions": predictions.ORACLE["f21_promotions"],
    "st11_query_log": sql("""SELECT 'q' || query_id AS query_id, queried_at, 'L' AS mode, 'R' || (origin % 3) AS line, origin AS boarding_int_id, destination AS alighting_int_id, success,
      CASE WHEN success THEN round(query_id / 4.0::DOUBLE, 6) ELSE -1.0::DOUBLE END AS predicted_wait_p50 FROM requests""", "requests"),
    "st16_rolling_promotion": ROLLING_SQL,
}
