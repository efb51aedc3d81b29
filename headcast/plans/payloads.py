"""Queries of the payload parsers: feeds are written as the JSON that they come in, parsed, and compared with their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions import text as words
from headcast.functions.scores import rounded
from headcast.operators import detours, joins, sinks
from headcast.plans.arrivals import E
from headcast.sources import ingest, proxies
from headcast.sources.proxies import sql


def clock_text(at: Column, form: str = "yyyyMMdd HH:mm:ss") -> Column:
    return F.date_format(at, form)


def parcels(rows: DataFrame, item: Column, order: str = "event_id", size: int = 200) -> DataFrame:
    """Items in arrays of about ``size``, by a number that grows with the table, so that no parcel does."""
    return rows.groupBy(F.floor(F.col(order) / size).alias("poll_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("l")).select("poll_id", F.transform("l", lambda x: x["i"]).alias("items"))


def bustime(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("poll_id", F.to_json(F.struct(F.struct(F.col("items").alias(name)).alias("bustime-response"))).alias("body"))


def bit(c: Column) -> Column:
    return F.when(c, "1").otherwise("0")


def a2_train_positions(s: SparkSession, d: str) -> DataFrame:
    p = proxies.positions(s, d)
    train = F.struct(
        F.col("run").cast("string").alias("rn"), F.col("station").cast("string").alias("nextStaId"), clock_text(F.col("polled_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("prdt"), bit(F.col("approaching")).alias("isApp"), F.col("lat").cast("string").alias("lat"),
        F.col("lon").cast("string").alias("lon"), F.col("direction_code").alias("trDr"), F.concat(F.lit("to "), "direction_code").alias("destNm"),
    )
    by = p.groupBy("line", F.floor(F.col("event_id") / 200).alias("poll_id")).agg(F.collect_list(train).alias("train"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("line").alias("@name"), "train")).alias("route")).alias("ctatt")))
    rows = ingest.train_positions(by.select("poll_id", body.alias("body")))
    return rows.groupBy("line", "station", "direction_code", "destination").agg(F.count("*").alias("n"), F.count_if("approaching").alias("n_approaching"), rounded(F.sum("lat"), 3).alias("lat"), F.max("predicted_at").cast("timestamp_ntz").alias("latest"))


def a4_train_follow(s: SparkSession, d: str) -> DataFrame:
    """The stops of each run and day, in the order in which they are foreseen."""
    a = proxies.arrivals(s, d).withColumn("day", F.date_trunc("day", "polled_at"))
    eta = F.struct(F.col("run").cast("string").alias("rn"), F.col("line").alias("rt"), F.col("station").cast("string").alias("staId"), clock_text(F.col("arrival_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("arrT"), bit(F.col("approaching")).alias("isApp"))
    by = a.groupBy("line", "run", "day").agg(F.sort_array(F.collect_list(F.struct("arrival_at", "event_id", eta.alias("e")))).alias("l"))
    body = F.to_json(F.struct(F.struct(clock_text(F.col("day"), "yyyy-MM-dd'T'HH:mm:ss").alias("tmst"), F.transform("l", lambda x: x["e"]).alias("eta")).alias("ctatt")))
    rows = ingest.train_follow(by.select(F.concat_ws(":", "line", "run", "day").alias("poll_id"), "day", body.alias("body")))
    return rows.select("line", "run", "day", F.col("seq").cast("bigint").alias("seq"), F.col("station").cast("bigint").alias("station"), rounded(F.col("eta_s"), 3).alias("eta_s"))


def a8_bus_predictions(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d)
    wait = F.floor((F.unix_micros(F.col("arrival_at").cast("timestamp")) - F.unix_micros(F.col("polled_at").cast("timestamp"))) / 60e6)
    prd = F.struct(
        clock_text(F.col("polled_at")).alias("tmstmp"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("D").alias("typ"), F.col("station").cast("string").alias("stpid"), F.col("run").cast("string").alias("vid"), F.col("line").alias("rt"),
        F.col("direction_code").alias("rtdir"), clock_text(F.col("arrival_at")).alias("prdtm"), F.when(F.col("event_id") % 17 == 0, "DLY").when(wait <= 0, "DUE").otherwise(wait.cast("string")).alias("prdctdn"), F.col("delayed").cast("string").alias("dly"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 20).cast("string")).alias("dyn"), (F.col("event_id") % 3).cast("string").alias("flagstop"),
    )
    payloads = bustime(parcels(a, prd), "prd").withColumn("server_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    rows = ingest.bus_predictions(payloads)
    return rows.groupBy("line", "stop", "typ", "direction", "flagstop").agg(
        F.count("*").alias("n"), F.count_if("approaching").alias("n_approaching"), F.count("minutes").alias("n_minutes"), F.count_if("delayed").alias("n_delayed"), F.sum("dyn").alias("dyn"), rounded(F.sum("prediction_age_s"), 3).alias("age_s"), rounded(F.sum("eta_s"), 3).alias("eta_s")
    )


def a9_bus_vehicles(s: SparkSession, d: str) -> DataFrame:
    v = proxies.vehicles(s, d)
    item = F.struct(
        F.col("vid").cast("string").alias("vid"), F.floor(F.col("at_s")).cast("string").alias("tmstmp"), F.col("lat").cast("string").alias("lat"), F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("lon").cast("string")).alias("lon"), F.col("heading").cast("string").alias("hdg"),
        F.col("pid").cast("string").alias("pid"), F.lit("22").alias("rt"), F.col("pdist").cast("string").alias("pdist"),
    )
    payloads = bustime(parcels(v, item), "vehicle").withColumn("server_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    rows = ingest.bus_vehicles(payloads)
    return rows.groupBy("vehicle", "pid").agg(F.count("*").alias("n"), F.count("lon").alias("n_lon"), rounded(F.sum("pdist_ft"), 1).alias("pdist_ft"), rounded(F.sum("vehicle_age_s"), 1).alias("age_s"))


def a10_routes(s: SparkSession, d: str) -> DataFrame:
    """Routes as the newest poll has them: parsed, then written over by id."""
    sup = proxies.table(s, d, "supplier")
    item = F.struct(F.concat(F.lit(" R"), F.col("s_suppkey") % 40).alias("rt"), F.col("s_name").alias("rtnm"), F.lit("#fff").alias("rtclr"))
    rows = ingest.bus_routes(bustime(parcels(sup, item, "s_suppkey", 50), "routes"))
    return sinks.overwrite(rows.limit(0), rows, ["rt"], "poll_id").select("rt", F.col("poll_id"), "colour")


def a12_pattern_points(s: SparkSession, d: str) -> DataFrame:
    n = proxies.pattern_points(s, d)
    point = F.struct(F.col("seq").cast("string").alias("seq"), F.lit("S").alias("typ"), F.col("stop").cast("string").alias("stpid"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), F.col("pdist").cast("string").alias("pdist"))
    by = n.groupBy("pid").agg(F.collect_list(point).alias("pt"), F.collect_list(F.when(F.col("seq") < 3, point)).alias("dtrpt"))
    items = by.select(F.col("pid").alias("poll_id"), F.array(F.struct(F.col("pid").cast("string").alias("pid"), F.lit("East").alias("rtdir"), F.lit("9").alias("ln"), "pt", "dtrpt")).alias("items"))
    rows = ingest.bus_pattern_points(ingest.bus_patterns(bustime(items, "ptr")))
    return rows.select("pid", "seq", "is_original", "stop", rounded(F.col("pdist_ft"), 2).alias("pdist_ft"))


def a15_errors(s: SparkSession, d: str) -> DataFrame:
    bad = proxies.arrivals(s, d).where("fault")
    rows = ingest.bus_errors(bustime(parcels(bad, F.struct(F.lit("No data found").alias("msg"), F.col("line").alias("rt"), F.col("station").cast("string").alias("stpid"))), "error"))
    return rows.groupBy("msg", "rt", "stpid").agg(F.count("*").alias("n"))


def a16_trip_updates(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d)
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    stop = F.struct(F.col("station").cast("string").alias("stop_id"), F.struct(t("arrival_at").alias("time"), (F.col("event_id") % 120).cast("int").alias("delay")).alias("arrival"), F.when(F.col("event_id") % 2 == 0, F.struct((t("arrival_at") + 30).alias("time"), (F.col("event_id") % 90).cast("int").alias("delay"))).alias("departure"))
    by = a.groupBy("line", "run", F.floor(F.col("event_id") / 2000).alias("poll_id")).agg(F.collect_list(stop).alias("stop_time_update"))
    entity = F.struct(F.col("run").cast("string").alias("id"), F.struct(F.struct(F.concat_ws(":", "line", "run").alias("trip_id"), F.col("line").alias("route_id"), F.lit(1).alias("direction_id")).alias("trip"), F.struct(F.col("run").cast("string").alias("id")).alias("vehicle"), "stop_time_update").alias("trip_update"))
    body = F.to_json(F.struct(F.struct(F.lit(1700000000).alias("timestamp")).alias("header"), F.array(entity).alias("entity")))
    rows = ingest.trip_updates(by.select("poll_id", body.alias("body")))
    return rows.groupBy("line", "stop").agg(F.count("*").alias("n"), F.countDistinct("trip_id").alias("n_trips"))


def detour_rows(s: SparkSession, d: str) -> DataFrame:
    """Detours written as the feed sends them: one per supplier, with pattern pairs, trips and stops."""
    k = F.col("s_suppkey")
    way = F.when(k % 2 == 0, "North").otherwise("South")
    item = F.struct(
        F.when(k % 19 != 0, F.concat(F.lit("D"), k % 60)).alias("id"), F.when(k % 5 != 0, (k % 3).cast("string")).alias("ver"), (k % 2).cast("string").alias("st"), F.col("s_name").alias("desc"), F.array(F.struct(F.concat(F.lit("R"), k % 8).alias("rt"), way.alias("dir"))).alias("rtdirs"),
        F.array(F.struct((k % 50).cast("string").alias("origpid"), F.when(k % 7 != 0, (k % 11).cast("string")).alias("dtrpid"), (k % 9).cast("string").alias("dtrdelay"))).alias("ptrs"), F.struct(k.cast("string").alias("tripid"), F.lit("t").alias("tatripid")).alias("trips"),
        F.struct((k % 30).cast("string").alias("stpid"), F.lit("41.5").alias("lat")).alias("dtrstartstop"), F.array(F.struct((k % 31).cast("string").alias("stpid"), F.lit("2").alias("seq"))).alias("repstops"),
    )
    payloads = bustime(parcels(proxies.table(s, d, "supplier"), item, "s_suppkey", 20), "dtrs")
    return detours.newest_detours(detours.detours(payloads), "poll_id")


def a13_detours(s: SparkSession, d: str) -> DataFrame:
    rows = detour_rows(s, d)
    return rows.select("detour_pk", "first_seen", "last_seen")


def a14_detour_children(s: SparkSession, d: str) -> DataFrame:
    rows = detour_rows(s, d)
    n = lambda part, name: part.groupBy("detour_pk").agg(F.count("*").alias(name))
    ids = rows.select("detour_pk")
    for part, name in ((detours.detour_patterns(rows), "n_patterns"), (detours.detour_trips(rows), "n_trips"), (detours.detour_stops(rows), "n_stops")):
        ids = ids.join(n(part, name), "detour_pk", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    # which of a detour's payloads is newest decides its children, so they are summed up rather than listed
    return ids.agg(F.count("*").alias("n"), F.sum("n_trips").alias("n_trips"), F.sum("n_stops").alias("n_stops"))


def known_detours(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return proxies.table(s, d, "supplier").select(
        F.concat(F.lit("d"), k).alias("id"), (k % 2).cast("int").alias("state"), F.array(F.struct(F.upper(F.concat(F.lit("r"), k % 8)).alias("rt"), F.when(k % 3 == 0, "North").otherwise("South").alias("dir"))).alias("routes")
    )


def u3_on_detour(s: SparkSession, d: str) -> DataFrame:
    rows = proxies.arrivals(s, d).select("event_id", F.concat(F.lit("r"), F.col("run") % 12).alias("rt"), F.when(F.col("event_id") % 4 != 0, F.col("direction_code")).alias("rtdir"))
    out = detours.on_detour(rows, detours.active_routes(known_detours(s, d)), F.col("rt"), F.col("rtdir"))
    return out.select("event_id", "detour_active")


def j17_stop_changes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    stops = proxies.table(s, d, "part").select(k.alias("stpid"), F.array(F.concat(F.lit("D"), k % 90), F.concat(F.lit("D"), k % 7)).alias("added"), F.when(k % 3 == 0, F.array(F.concat(F.lit("d"), (k + 1) % 120))).alias("removed"))
    return detours.stop_changes(stops, known_detours(s, d)).select("stpid", "stop_added", "stop_removed")


def j14_pattern_choice(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    patterns = proxies.table(s, d, "part").select(k.cast("int").alias("pid"), F.concat(F.lit("r"), k % 6).alias("rt"), F.when(k % 2 == 0, "north").otherwise("south").alias("rtdir"), (100.0 * (k % 10)).alias("length_ft"))
    rows = proxies.arrivals(s, d).select("event_id", F.concat(F.lit("r"), F.col("run") % 7).alias("rt"), F.col("direction_code").alias("rtdir"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("int")).alias("pid"))
    return detours.pattern_choice(rows, patterns).select("event_id", F.coalesce("pattern", F.lit(-1)).alias("pattern"))


def a31_new_archives(s: SparkSession, d: str) -> DataFrame:
    """Archives whose content no earlier one of their agency had, the first of each."""
    rows = proxies.table(s, d, "orders").select(F.col("o_orderpriority").alias("agency"), F.sha2(F.concat_ws("|", "o_orderstatus", (F.col("o_custkey") % 40).cast("string")), 256).alias("hash"), F.col("o_orderkey").alias("archive_id"))
    return sinks.insert_if_absent(rows.where("archive_id % 10 = 0"), rows.where("archive_id % 10 <> 0"), ["agency", "hash"], "archive_id")


def j19_fallback_places(s: SparkSession, d: str) -> DataFrame:
    """Coordinates of each arrival's station: the catalogue's, else where its line was last seen there, else none."""
    known = proxies.pattern_points(s, d).groupBy(F.col("stop").cast("bigint").alias("station")).agg(F.min("lat").alias("lat")).where("station < 8")
    seen = joins.latest_by(proxies.positions(s, d).select("station", "polled_at", "event_id", F.col("lat").alias("seen_lat")), ["station"], "polled_at", "event_id").select("station", "seen_lat")
    rows = proxies.arrivals(s, d).groupBy("line", "station").agg(F.count("*").alias("n"))
    out = rows.join(known, "station", "left").join(seen, "station", "left")
    return out.select("line", "station", "n", rounded(F.coalesce("lat", "seen_lat"), 4).alias("lat"), F.when(F.col("lat").isNotNull(), "catalogue").when(F.col("seen_lat").isNotNull(), "seen").otherwise("none").alias("source"))


def s_texts(s: SparkSession, d: str) -> DataFrame:
    e = proxies.table(s, d, "events")
    k = F.col("event_id")
    quality = F.element_at(F.array(*map(F.lit, ("HIGH confidence", "medium", "Low", "??"))), (k % 4 + 1).cast("int"))
    levels = F.map_from_arrays(F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)), F.array(F.col("value"), F.col("value") + 1, F.col("value") + 2))
    return e.select(
        "event_id", words.compass(F.lit(0.0), F.lit(0.0), (k % 7 - 3).cast("double"), (k % 5 - 2).cast("double")).alias("way"), words.iso_of_millis(F.lit(1_700_000_000_000) + k * 1001).alias("iso"), words.quality_bin(quality).alias("quality"), words.quality_of_score(k % 100 / 100.0).alias("score_bin"),
        words.minutes_text((k % 400).cast("double") * 1.5).alias("wait"), F.size(words.batches(F.sequence(F.lit(1), (k % 11 + 1).cast("int")), 4)).alias("n_batches"), rounded(words.nearest_quantile(levels, 0.8)).alias("q80"),
    )


FAMILY = (
    a2_train_positions, a4_train_follow, a8_bus_predictions, a9_bus_vehicles, a10_routes, a12_pattern_points, a13_detours, a14_detour_children, a15_errors, a16_trip_updates, u3_on_detour, j17_stop_changes, j14_pattern_choice, a31_new_archives, j19_fallback_places, s_texts,
)
QUERIES = {f.__name__: f for f in FAMILY}

PK = "'D' || (s_suppkey % 60) || ':' || CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 3 AS VARCHAR) ELSE '' END"
SERVER = "epoch(TIMESTAMP '2024-01-31')"
DETOURS = "SELECT 'd' || s_suppkey AS id, s_suppkey % 2 AS state, 'r' || (s_suppkey % 8) AS rt, CASE WHEN s_suppkey % 3 = 0 THEN 'north' ELSE 'south' END AS dir FROM supplier"
ORACLE = {
    "a2_train_positions": sql("SELECT line, station, direction_code, 'to ' || direction_code AS destination, count(*) AS n, count(*) FILTER (WHERE approaching) AS n_approaching, round(sum(lat), 3) AS lat, date_trunc('second', max(polled_at)) AS latest FROM positions GROUP BY ALL", "positions"),
    "a4_train_follow": sql("SELECT line, CAST(run AS VARCHAR) AS run, date_trunc('day', polled_at) AS day, row_number() OVER (PARTITION BY line, run, date_trunc('day', polled_at) ORDER BY arrival_at, event_id) - 1 AS seq, station, round(epoch(date_trunc('second', arrival_at)) - epoch(date_trunc('day', polled_at)), 3)::DOUBLE AS eta_s FROM arrivals", "arrivals"),
    "a8_bus_predictions": sql(f"""SELECT line, CAST(station AS VARCHAR) AS stop, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS typ, direction_code AS direction, CAST(event_id % 3 AS INTEGER) AS flagstop, count(*) AS n, count(*) FILTER (WHERE event_id % 17 <> 0 AND w <= 1) AS n_approaching,
      count(*) FILTER (WHERE event_id % 17 <> 0) AS n_minutes, count(*) FILTER (WHERE delayed) AS n_delayed, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 20 ELSE 0 END) AS BIGINT) AS dyn, round(sum({SERVER} - epoch(date_trunc('second', polled_at))), 3)::DOUBLE AS age_s,
      round(sum(epoch(date_trunc('second', arrival_at)) - {SERVER}), 3)::DOUBLE AS eta_s FROM (SELECT *, greatest(0, floor((epoch_us(arrival_at) - epoch_us(polled_at)) / 60e6)) AS w FROM arrivals) GROUP BY ALL""", "arrivals"),
    "a9_bus_vehicles": sql(f"SELECT CAST(vid AS VARCHAR) AS vehicle, pid, count(*) AS n, count(*) FILTER (WHERE event_id % 9 <> 0) AS n_lon, round(sum(pdist), 1) AS pdist_ft, round(sum({SERVER} - floor(at_s)), 1)::DOUBLE AS age_s FROM vehicles GROUP BY ALL", "vehicles"),
    "a10_routes": "SELECT 'R' || (s_suppkey % 40) AS rt, max(CAST(floor(s_suppkey / 50) AS BIGINT)) AS poll_id, '#fff' AS colour FROM supplier GROUP BY 1",
    "a12_pattern_points": sql("SELECT pid, CAST(seq AS INTEGER) AS seq, original AS is_original, CAST(stop AS VARCHAR) AS stop, round(pdist, 2) AS pdist_ft FROM pattern_points, (VALUES (false), (true)) o(original) WHERE NOT original OR seq < 3", "pattern_points"),
    "a13_detours": f"SELECT {PK} AS detour_pk, min(CAST(floor(s_suppkey / 20) AS BIGINT)) AS first_seen, max(CAST(floor(s_suppkey / 20) AS BIGINT)) AS last_seen FROM supplier WHERE s_suppkey % 19 <> 0 GROUP BY 1",
    "a14_detour_children": f"SELECT count(*) AS n, count(*) AS n_trips, 2 * count(*) AS n_stops FROM (SELECT DISTINCT {PK} FROM supplier WHERE s_suppkey % 19 <> 0)",
    "a15_errors": sql("SELECT 'No data found' AS msg, line AS rt, CAST(station AS VARCHAR) AS stpid, count(*) AS n FROM arrivals WHERE fault GROUP BY ALL", "arrivals"),
    "a16_trip_updates": sql("SELECT line, CAST(station AS VARCHAR) AS stop, count(*) AS n, count(DISTINCT run) AS n_trips FROM arrivals GROUP BY ALL", "arrivals"),
    "u3_on_detour": sql("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN EXISTS (SELECT 1 FROM det WHERE det.rt = 'r' || (run % 12) AND det.dir = direction_code) ELSE EXISTS (SELECT 1 FROM det WHERE det.rt = 'r' || (run % 12)) END AS detour_active FROM arrivals""", "arrivals", det=f"SELECT DISTINCT rt, dir FROM ({DETOURS}) WHERE state = 1"),
    "j17_stop_changes": f"""WITH act AS (SELECT upper(id) AS id FROM ({DETOURS}) WHERE state = 1) SELECT p_partkey AS stpid, ('D' || (p_partkey % 90)) IN (SELECT id FROM act) OR ('D' || (p_partkey % 7)) IN (SELECT id FROM act) AS stop_added,
      p_partkey % 3 = 0 AND ('D' || ((p_partkey + 1) % 120)) IN (SELECT id FROM act) AS stop_removed FROM part""",
    "j14_pattern_choice": sql("""SELECT event_id, CAST(coalesce(k.pid, b.pid, -1) AS INTEGER) AS pattern FROM (SELECT event_id, 'r' || (run % 7) AS rt, direction_code AS rtdir, CASE WHEN event_id % 3 = 0 THEN event_id % 90 END AS pid FROM arrivals) a LEFT JOIN pat k ON k.pid = a.pid
      LEFT JOIN (SELECT rt, rtdir, arg_max(pid, (len, -pid)) AS pid FROM pat GROUP BY ALL) b ON b.rt = a.rt AND b.rtdir = a.rtdir""", "arrivals",
      pat="SELECT p_partkey AS pid, 'r' || (p_partkey % 6) AS rt, CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS rtdir, 100.0 * (p_partkey % 10) AS len FROM part"),
    "a31_new_archives": """WITH r AS (SELECT o_orderpriority AS agency, sha256(concat_ws('|', o_orderstatus, CAST(o_custkey % 40 AS VARCHAR))) AS hash, o_orderkey AS archive_id FROM orders) SELECT agency, hash, min(archive_id) AS archive_id FROM r WHERE archive_id % 10 <> 0
      AND NOT EXISTS (SELECT 1 FROM r t WHERE t.archive_id % 10 = 0 AND t.agency = r.agency AND t.hash = r.hash) GROUP BY ALL""",
    "j19_fallback_places": sql("""SELECT a.line, a.station, a.n, round(coalesce(k.lat, s.lat), 4) AS lat, CASE WHEN k.lat IS NOT NULL THEN 'catalogue' WHEN s.lat IS NOT NULL THEN 'seen' ELSE 'none' END AS source FROM (SELECT line, station, count(*) AS n FROM arrivals GROUP BY ALL) a
      LEFT JOIN (SELECT stop, min(lat) AS lat FROM pattern_points WHERE stop < 8 GROUP BY 1) k ON k.stop = a.station LEFT JOIN (SELECT station, arg_max(lat, (polled_at, event_id)) AS lat FROM positions GROUP BY 1) s ON s.station = a.station""", "arrivals", "positions", "pattern_points"),
    "s_texts": """SELECT event_id, CASE WHEN abs(u) >= abs(r) THEN CASE WHEN u >= 0 THEN 'northbound' ELSE 'southbound' END ELSE CASE WHEN r >= 0 THEN 'eastbound' ELSE 'westbound' END END AS way, strftime(epoch_ms(1700000000000 + event_id * 1001), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS iso,
      (['high', 'medium', 'low', 'any'])[event_id % 4 + 1] AS quality, CASE WHEN event_id % 100 >= 75 THEN 'high' WHEN event_id % 100 >= 55 THEN 'medium' ELSE 'low' END AS score_bin, CASE WHEN m <= 0 THEN 'due now' WHEN m = 1 THEN '1 minute' ELSE m || ' minutes' END AS wait,
      CAST(ceil((event_id % 11 + 1) / 4.0) AS INTEGER) AS n_batches, round(value + 1, 6) AS q80 FROM (SELECT *, event_id % 7 - 3 AS u, event_id % 5 - 2 AS r, CAST(round_even((event_id % 400) * 1.5::DOUBLE / 60, 0) AS BIGINT) AS m FROM events)""",
}
