"""Feed parsers compared row by row: bodies are written as each feed sends them, many items to a body, and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.operators import sinks
from headcast.sources import feeds, ingest, proxies
from headcast.sources.proxies import sql

#: Items to a body.
TOGETHER = 40


def packed(rows: DataFrame, item: Column, wrap) -> DataFrame:
    """Bodies of up to ``TOGETHER`` items each; ``wrap`` makes a body's columns of the list of items."""
    by = rows.groupBy(F.floor(F.col("event_id") / TOGETHER).alias("poll_id")).agg(F.collect_list(item).alias("items"))
    return by.select("poll_id", F.to_json(wrap(F.col("items"))).alias("body"))


def events(s: SparkSession, d: str) -> DataFrame:
    return proxies.arrivals(s, d).join(proxies.vehicles(s, d).select("event_id", "vid", "lat", "lon", "heading"), "event_id")


def text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def iso(ts: str, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def plain(c: Column, name: str) -> Column:
    return c.cast("timestamp_ntz").alias(name)


def a16_stop_times(s: SparkSession, d: str) -> DataFrame:
    """Predicted times prefer the departure; a delay of over a minute counts as delayed."""
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    n = F.col("event_id")
    stop = F.struct(
        text("station").alias("stop_id"), n.cast("int").alias("stop_sequence"), F.struct(t("arrival_at").alias("time"), (n % 120).cast("int").alias("delay")).alias("arrival"),
        F.when(n % 3 != 0, F.struct(F.when(n % 3 == 1, t("arrival_at") + 30).otherwise(0).alias("time"), F.when(n % 2 == 0, (n % 90).cast("int")).alias("delay"))).alias("departure"),
    )
    trip = F.struct(F.concat_ws(":", "line", text("run")).alias("trip_id"), F.col("line").alias("route_id"), F.lit(1).alias("direction_id"))
    item = F.struct(text("event_id").alias("id"), F.struct(trip.alias("trip"), F.struct(text("run").alias("id")).alias("vehicle"), F.array(stop).alias("stop_time_update")).alias("trip_update"))
    rows = ingest.trip_updates(packed(events(s, d), item, lambda x: F.struct(F.struct(F.lit(1700000000).alias("timestamp")).alias("header"), x.alias("entity"))))
    return rows.select(F.col("seq").cast("bigint").alias("event_id"), "trip_id", "line", "stop", "vehicle", F.col("predicted_s").cast("bigint").alias("predicted_s"), F.col("delay_s").cast("bigint").alias("delay_s"), "delayed")


def a17_vehicle_positions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    vehicle = F.struct(
        F.struct(text("run").alias("trip_id"), F.col("line").alias("route_id")).alias("trip"), F.struct(F.when(n % 9 != 0, text("event_id")).alias("id"), F.lit("car").alias("label")).alias("vehicle"),
        F.struct("lat", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.coalesce("heading", F.lit(1.5)).alias("bearing")).alias("position"), F.when(F.col("approaching"), "INCOMING_AT").otherwise("IN_TRANSIT_TO").alias("current_status"),
        F.lit("RUNNING_SMOOTHLY").alias("congestion_level"), F.when(n % 2 == 0, "FEW_SEATS").otherwise("FULL").alias("occupancy_status"), text("station").alias("stop_id"), F.unix_seconds(F.col("polled_at").cast("timestamp")).alias("timestamp"),
    )
    rows = feeds.vehicle_positions(packed(events(s, d), F.struct(text("event_id").alias("id"), vehicle.alias("vehicle")), lambda x: F.struct(x.alias("entity"))))
    return rows.select("vehicle", "trip_id", "line", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("heading", 6).alias("heading"), "status", "congestion", "occupancy", "stop", plain(F.col("at"), "at"))


def a18_realtime_alerts(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    words = lambda c: F.struct(F.array(F.struct(c.alias("text"), F.lit("en").alias("language")), F.struct(F.lit("otro").alias("text"), F.lit("es").alias("language"))).alias("translation"))
    alert = F.struct(
        F.when(F.col("fault"), "TECHNICAL_PROBLEM").otherwise("MAINTENANCE").alias("cause"), F.lit("DETOUR").alias("effect"), F.when(n % 4 != 0, "SEVERE").alias("severity_level"), words(F.concat(F.lit("At "), text("station"))).alias("header_text"), words(F.col("line")).alias("description_text"),
        F.array(F.struct(n.alias("start"), (n + 60).alias("end"))).alias("active_period"), F.array(F.struct(F.col("line").alias("route_id"), text("station").alias("stop_id"))).alias("informed_entity"),
    )
    item = F.struct(text("event_id").alias("id"), F.when(n % 13 != 0, alert).alias("alert"))
    rows = feeds.realtime_alerts(packed(events(s, d), item, lambda x: F.struct(x.alias("entity"))))
    first = F.get("entities", F.lit(0))
    return rows.select("alert_id", "cause", "effect", F.coalesce("severity", F.lit("none")).alias("severity"), "header", "description", F.get("periods", F.lit(0))["end"].alias("until_s"), first["route_id"].alias("line"), first["stop_id"].alias("stop"))


def a21_service_alerts(s: SparkSession, d: str) -> DataFrame:
    """Each item alone in its body, every other one as an object rather than a list."""
    n = F.col("event_id")
    inner = F.to_json(F.struct(
        text("event_id").alias("AlertId"), F.concat(F.lit("Line "), "line").alias("Headline"), F.struct(F.concat(F.lit("run "), text("run")).alias("#cdata-section")).alias("ShortDescription"), text(n % 100).alias("SeverityScore"),
        iso("polled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("EventStart"), F.when(n % 2 == 0, "1").otherwise("0").alias("MajorAlert"),
    ))
    body = F.concat(F.lit('{"CTAAlerts": {"Alert": '), F.when(n % 2 == 0, inner).otherwise(F.concat(F.lit("["), inner, F.lit("]"))), F.lit("}}"))
    rows = feeds.service_alerts(events(s, d).select(body.alias("body")))
    return rows.select("alert_id", "headline", "description", "severity", plain(F.col("starts_at"), "starts_at"), "major")


def a22_weather(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    now = F.struct(iso("polled_at", "yyyy-MM-dd'T'HH:mm").alias("time"), (n % 50 - 20).cast("double").alias("temperature_2m"), (n % 7 / 2).alias("rain"), (n % 90).cast("int").alias("weather_code"))
    body = F.when(n % 10 != 0, F.to_json(F.struct(now.alias("current")))).otherwise('{"error": true}')
    rows = feeds.weather(events(s, d).select("event_id", body.alias("body")))
    return rows.select("event_id", plain(F.col("at"), "at"), "temperature", "rain", "code")


def a23_air_quality(s: SparkSession, d: str) -> DataFrame:
    """Observed and forecast rows in one table."""
    n = F.col("event_id")
    item = F.struct(
        F.when(n % 3 != 0, F.concat(iso("polled_at", "yyyy-MM-dd"), F.lit(" "))).alias("DateObserved"), F.when(n % 3 == 0, iso("arrival_at", "yyyy-MM-dd")).alias("DateForecast"), F.concat(F.lit("P"), text("event_id")).alias("ParameterName"),
        (n % 200).cast("int").alias("AQI"), F.struct((n % 6).cast("int").alias("Number")).alias("Category"), (n % 3 == 0).alias("ActionDay"),
    )
    rows = feeds.air_quality(packed(events(s, d), item, lambda x: x))
    return rows.select("parameter", F.col("day").cast("string").alias("day"), "is_forecast", "aqi", "category", "action_day")


def a24_sports(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    side = lambda who, score, name: F.struct(F.lit(who).alias("homeAway"), score.cast("string").alias("score"), F.struct(name.alias("displayName")).alias("team"))
    home, away = side("home", n % 9, F.col("line")), side("away", n % 7, F.concat(F.lit("T"), text("station")))
    sides = F.when(n % 2 == 0, F.array(home, away)).otherwise(F.array(away, home))
    match = F.struct((n % 1000).cast("int").alias("attendance"), F.struct(F.concat(F.lit("Park "), text("station")).alias("fullName")).alias("venue"), sides.alias("competitors"))
    item = F.struct(text("event_id").alias("id"), iso("polled_at", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(F.struct(F.when(F.col("delayed"), "in").otherwise("post").alias("state"), (~F.col("delayed")).alias("completed")).alias("type")).alias("status"), F.array(match).alias("competitions"))
    rows = feeds.sports_events(packed(events(s, d), item, lambda x: F.struct(x.alias("events"))))
    return rows.select("event_id", plain(F.col("starts_at"), "starts_at"), "state", "completed", "venue", "attendance", "home", "away", "home_score", "away_score")


def a25_venues(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    names = lambda *c: F.array(*[F.struct(x.alias("name")) for x in c])
    item = F.struct(
        text("event_id").alias("id"), F.col("line").alias("name"), F.struct(F.struct(iso("polled_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")).alias("start")).alias("dates"), F.when(n % 4 != 0, F.array(F.struct(F.struct(F.lit("Music").alias("name")).alias("segment")))).alias("classifications"),
        F.struct(names(F.concat(F.lit("Hall "), text("station")), F.lit("Other")).alias("venues")).alias("_embedded"),
    )
    rows = feeds.venue_events(packed(events(s, d), item, lambda x: F.struct(F.struct(x.alias("events")).alias("_embedded"))))
    return rows.select("event_id", "name", plain(F.col("starts_at"), "starts_at"), "venue", F.coalesce("kind", F.lit("none")).alias("kind"))


def a26_social(s: SparkSession, d: str) -> DataFrame:
    stamp = iso("polled_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows, n = events(s, d), F.col("event_id")
    one = F.struct(F.concat(F.lit("at://"), text("event_id")).alias("uri"), F.struct(F.col("line").alias("handle")).alias("author"), F.struct(F.concat(F.lit("late "), text("run")).alias("text"), stamp.alias("createdAt")).alias("record"))
    two = F.struct(text("event_id").alias("id"), F.struct(F.col("line").alias("acct")).alias("account"), F.concat(F.lit("<p>stuck "), text("run"), F.lit("</p>")).alias("content"), stamp.alias("created_at"))
    both = packed(rows.where(n % 2 == 0), one, lambda x: F.struct(x.alias("posts"))).unionByName(packed(rows.where(n % 2 == 1), two, lambda x: F.struct(x.alias("statuses"))))
    return feeds.social_posts(both).select("network", "post_id", "author", "text", plain(F.date_trunc("second", "at"), "at"))


def a27_traffic(s: SparkSession, d: str) -> DataFrame:
    """Segments and regions; times with and without a T, a speed of -1 is unknown."""
    rows, n = events(s, d), F.col("event_id")
    speed = F.when(n % 5 == 0, F.lit(-1)).otherwise(n % 60)
    one = F.struct(text("event_id").alias("segmentid"), F.col("line").alias("street"), text(speed).alias("_traffic"), iso("polled_at", "yyyy-MM-dd HH:mm:ss.S").alias("_last_updt"))
    two = F.struct(text("event_id").alias("_region_id"), F.col("line").alias("region"), text(speed).alias("current_speed"), iso("polled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"))
    both = packed(rows.where(n % 2 == 0), one, lambda x: x).unionByName(packed(rows.where(n % 2 == 1), two, lambda x: x))
    return feeds.traffic(both).select("kind", "place_id", "name", F.coalesce("speed_mph", F.lit(-1.0)).alias("speed_mph"), plain(F.date_trunc("second", "at"), "at"))


def a28_open_data(s: SparkSession, d: str) -> DataFrame:
    """Records with their own id or, without one, the hash of their text."""
    n = F.col("event_id")
    item = F.struct(F.when(n % 3 != 0, text("event_id")).alias("id"), n.alias("number"), F.col("line").alias("kind"))
    rows = feeds.open_data(packed(events(s, d), item, lambda x: x))
    return rows.select("poll_id", "record_id", F.get_json_object("record", "$.number").cast("bigint").alias("number"), F.get_json_object("record", "$.kind").alias("kind"))


def a36_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Stations per served line, and the first station of each name."""
    k = F.col("s_suppkey")
    stations = proxies.table(s, d, "supplier").select(k.alias("map_id"), F.concat(F.lit("Stop "), text(k % 37)).alias("name"), F.filter(F.array(F.when(k % 2 == 0, "Red"), F.when(k % 3 == 0, "Blue"), F.when(k % 5 == 0, "Pink")), lambda x: x.isNotNull()).alias("served_lines"))
    made = feeds.station_catalogue(stations)
    return made["by_line"].join(made["by_name"].select("name", F.col("map_id").alias("first_id")), "name").select("map_id", "name", "line", "first_id")


def _bustime(rows: DataFrame, item: Column, name: str, *keep: str) -> DataFrame:
    """Bodies of one item each, with the columns ``keep``."""
    return rows.select(*keep, F.to_json(F.struct(F.struct(F.array(item).alias(name)).alias("bustime-response"))).alias("body"))


def a6_legacy_predictions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    told = F.when(n % 17 == 0, "DLY").when(n % 5 == 0, "due ").when(n % 7 == 0, "soon").when(n % 11 != 0, text(n % 40))
    item = F.struct(text("station").alias("stpid"), text("event_id").alias("vid"), F.col("line").alias("rt"), told.alias("prdctdn"))
    return ingest.legacy_bus_predictions(_bustime(proxies.arrivals(s, d), item, "prd")).select("vehicle", "line", "stop", "minutes", "approaching")


def a10_directions(s: SparkSession, d: str) -> DataFrame:
    """Directions of routes as the newest poll names them; the feed has them with an id or without."""
    n = F.col("event_id")
    item = F.struct(F.when(n % 2 == 0, F.col("direction_code")).alias("id"), F.when(n % 2 == 0, F.concat("direction_code", F.lit("bound "), text("station"))).alias("name"), F.when(n % 2 == 1, F.concat(F.lit(" "), "direction_code")).alias("dir"))
    rows = ingest.bus_directions(_bustime(proxies.arrivals(s, d), item, "directions", F.col("line").alias("rt"), n.alias("poll_id")))
    return sinks.overwrite(rows.limit(0), rows, ["rt", "direction"], "poll_id").select("rt", "direction", "name", "poll_id")


def a11_stops(s: SparkSession, d: str) -> DataFrame:
    """Stops where a poll without coordinates or route keeps those that were known."""
    n = F.col("event_id")
    item = F.struct(text("station").alias("stpid"), F.concat(F.lit("Stop "), text(n % 3)).alias("stpnm"), F.when(n % 4 == 0, text("lat")).alias("lat"), F.when(n % 4 == 0, "east").when(n % 4 == 1, text("lon")).alias("lon"))
    rows = ingest.bus_stops(_bustime(events(s, d), item, "stops", F.when(n % 6 == 0, F.col("line")).alias("rt"), n.alias("poll_id")))
    out = sinks.coalescing_upsert(rows.limit(0), rows, ["stop"], "poll_id")
    return out.select("stop", "name", F.coalesce("rt", F.lit("none")).alias("rt"), F.round(F.coalesce("lat", F.lit(0.0)), 6).alias("lat"), F.round(F.coalesce("lon", F.lit(0.0)), 6).alias("lon"), "poll_id")


def _targets(s: SparkSession, d: str) -> DataFrame:
    a = proxies.arrivals(s, d)
    known = a.where("station % 3 <> 0").select(F.col("line").alias("route"), F.col("station").alias("stop"), F.concat(F.col("direction_code"), F.lit("bound")).alias("direction_label"))
    return feeds.monitored_targets(a.select(F.col("line").alias("route"), F.col("station").alias("stop")), known)


def a37_targets(s: SparkSession, d: str) -> DataFrame:
    return _targets(s, d).select("rt", "stpid", F.coalesce("direction", F.lit("none")).alias("direction"))


def a37_target_lists(s: SparkSession, d: str) -> DataFrame:
    return feeds.target_lists(_targets(s, d)).select(*[F.array_join(c, ",").alias(c) for c in ("routes", "stops", "directions")])


def a37_station_targets(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    stations = proxies.table(s, d, "supplier").select(k.alias("map_id"), F.col("s_name").alias("name"), F.filter(F.array(F.when(k % 2 == 0, "Red"), F.when(k % 3 == 0, "Blue"), F.when(k % 5 == 0, "Pink")), lambda x: x.isNotNull()).alias("served_lines"))
    return feeds.station_targets(stations, ["Pink", "Red"]).select("map_id", "name", F.array_join("lines", ",").alias("lines"))


def g22_group_keys(s: SparkSession, d: str) -> DataFrame:
    """Prediction groups by all ten keys, unknown ones being equal to each other."""
    n = F.col("event_id")
    rows = proxies.arrivals(s, d).select(
        F.col("line").alias("rt"), "direction_code", text("station").alias("stpid"), text("run").alias("vid"), F.when(n % 3 == 0, text(n % 5)).alias("tatripid"), F.when(n % 2 == 0, "A").otherwise("D").alias("typ"), F.when(n % 4 == 0, "Loop").alias("des"),
        F.when(n % 5 == 0, (n % 3).cast("int")).alias("dyn"), (n % 7 == 0).alias("dly"), F.when(n % 9 == 0, 1).alias("flagstop"), "polled_at", "arrival_at",
    )
    keys = rows.columns[:10]
    by = rows.groupBy(*keys).agg(F.min("polled_at").alias("first_seen_at"), F.max("arrival_at").alias("last_predicted_at"), F.count("*").alias("n"))
    return by.select(*[F.coalesce(text(c), F.lit("-")).alias(c) for c in keys], "first_seen_at", "last_predicted_at", "n")


def g40_all_versions(s: SparkSession, d: str) -> DataFrame:
    """Versions that are built in, that have made forecasts, and that the registry names."""
    used = proxies.forecasts(s, d).select(F.col("predictor_version").alias("version"))
    fitted = proxies.table(s, d, "part").select(F.concat(F.lit("gbm-v"), text(F.col("p_size") % 4)).alias("version"))
    return used.union(fitted).union(s.createDataFrame([("kernel-v1",), ("kernel-v1+eb",)], "version string")).distinct()


QUERIES = {f.__name__: f for f in (
    a6_legacy_predictions, a10_directions, a11_stops, a37_targets, a37_target_lists, a37_station_targets, g22_group_keys, g40_all_versions,
    a16_stop_times, a17_vehicle_positions, a18_realtime_alerts, a21_service_alerts, a22_weather, a23_air_quality, a24_sports, a25_venues, a26_social, a27_traffic, a28_open_data, a36_catalogue,
)}

ID = "CAST(event_id AS VARCHAR)"
BOTH = {"both_": "SELECT a.*, v.lat, v.lon, v.heading FROM arrivals a JOIN vehicles v USING (event_id)"}
SECOND, MINUTE = "date_trunc('second', polled_at)", "date_trunc('minute', polled_at)"


def _sql(body: str) -> str:
    return sql(body, "arrivals", "vehicles", **BOTH)


TARGETS = """SELECT DISTINCT line AS rt, CAST(station AS VARCHAR) AS stpid, CASE WHEN station % 3 <> 0 THEN (SELECT min(b.direction_code || 'bound') FROM arrivals b WHERE b.line = a.line AND b.station = a.station) END AS direction FROM arrivals a"""
KEYS = {"tatripid": "CASE WHEN event_id % 3 = 0 THEN event_id % 5 END", "typ": "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END", "des": "CASE WHEN event_id % 4 = 0 THEN 'Loop' END", "dyn": "CASE WHEN event_id % 5 = 0 THEN event_id % 3 END", "dly": "event_id % 7 = 0", "flagstop": "CASE WHEN event_id % 9 = 0 THEN 1 END"}
ORACLE = {
    "a6_legacy_predictions": sql(f"""SELECT {ID} AS vehicle, line, CAST(station AS VARCHAR) AS stop, m AS minutes, m <= 1 AS approaching FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN 99 WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 99 WHEN event_id % 11 <> 0 THEN event_id % 40 ELSE 99 END::DOUBLE AS m FROM arrivals)""", "arrivals"),
    "a10_directions": sql("""SELECT rt, direction, name, poll_id FROM (SELECT line AS rt, direction_code AS direction, CASE WHEN event_id % 2 = 0 THEN direction_code || 'bound ' || station ELSE ' ' || direction_code END AS name, event_id AS poll_id,
      row_number() OVER (PARTITION BY line, direction_code ORDER BY event_id DESC) AS k FROM arrivals) WHERE k = 1""", "arrivals"),
    "a11_stops": _sql("""SELECT CAST(station AS VARCHAR) AS stop, arg_max('Stop ' || (event_id % 3), event_id) AS name, coalesce(arg_max(line, event_id) FILTER (WHERE event_id % 6 = 0), 'none') AS rt, round(coalesce(arg_max(lat, event_id) FILTER (WHERE event_id % 4 = 0), 0), 6) AS lat,
      round(coalesce(arg_max(lon, event_id) FILTER (WHERE event_id % 4 = 1), 0), 6) AS lon, max(event_id) AS poll_id FROM both_ GROUP BY station"""),
    "a37_targets": sql(f"SELECT rt, stpid, coalesce(direction, 'none') AS direction FROM ({TARGETS})", "arrivals"),
    "a37_target_lists": sql(f"SELECT string_agg(DISTINCT rt, ',' ORDER BY rt) AS routes, string_agg(DISTINCT stpid, ',' ORDER BY stpid) AS stops, string_agg(DISTINCT direction, ',' ORDER BY direction) AS directions FROM ({TARGETS})", "arrivals"),
    "a37_station_targets": "SELECT s_suppkey AS map_id, s_name AS name, concat_ws(',', CASE WHEN s_suppkey % 5 = 0 THEN 'Pink' END, CASE WHEN s_suppkey % 2 = 0 THEN 'Red' END) AS lines FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 2 = 0",
    "g22_group_keys": sql("SELECT rt, direction_code, stpid, vid, " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '-') AS {k}" for k in KEYS) + """, min(polled_at) AS first_seen_at, max(arrival_at) AS last_predicted_at, count(*) AS n
      FROM (SELECT line AS rt, direction_code, CAST(station AS VARCHAR) AS stpid, CAST(run AS VARCHAR) AS vid, polled_at, arrival_at, """ + ", ".join(f"{v} AS {k}" for k, v in KEYS.items()) + " FROM arrivals) GROUP BY ALL", "arrivals"),
    "g40_all_versions": sql("SELECT predictor_version AS version FROM forecasts UNION SELECT 'gbm-v' || (p_size % 4) FROM part UNION SELECT 'kernel-v1' UNION SELECT 'kernel-v1+eb'", "forecasts"),
    "a16_stop_times": _sql("""SELECT event_id, line || ':' || run AS trip_id, line, CAST(station AS VARCHAR) AS stop, CAST(run AS VARCHAR) AS vehicle, p AS predicted_s, dl AS delay_s, dl > 60 AS delayed
      FROM (SELECT *, CAST(floor(epoch(arrival_at)) AS BIGINT) + CASE WHEN event_id % 3 = 1 THEN 30 ELSE 0 END AS p, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN event_id % 90 ELSE event_id % 120 END AS dl FROM both_)"""),
    "a17_vehicle_positions": _sql(f"""SELECT {ID} AS vehicle, CAST(run AS VARCHAR) AS trip_id, line, round(lat, 6) AS lat, round(lon, 6) AS lon, round(coalesce(heading, 1.5), 6) AS heading, CASE WHEN approaching THEN 'incoming_at' ELSE 'in_transit_to' END AS status, 'running_smoothly' AS congestion,
      CASE WHEN event_id % 2 = 0 THEN 'few_seats' ELSE 'full' END AS occupancy, CAST(station AS VARCHAR) AS stop, {SECOND} AS at FROM both_ WHERE event_id % 9 <> 0"""),
    "a18_realtime_alerts": _sql(f"""SELECT {ID} AS alert_id, CASE WHEN fault THEN 'technical_problem' ELSE 'maintenance' END AS cause, 'detour' AS effect, CASE WHEN event_id % 4 <> 0 THEN 'severe' ELSE 'none' END AS severity, 'At ' || station AS header, line AS description, event_id + 60 AS until_s, line,
      CAST(station AS VARCHAR) AS stop FROM both_ WHERE event_id % 13 <> 0"""),
    "a21_service_alerts": _sql(f"SELECT {ID} AS alert_id, 'Line ' || line AS headline, 'run ' || run AS description, CAST(event_id % 100 AS INTEGER) AS severity, {SECOND} AS starts_at, event_id % 2 = 0 AS major FROM both_"),
    "a22_weather": _sql(f"SELECT event_id, {MINUTE} AS at, CAST(event_id % 50 - 20 AS DOUBLE) AS temperature, CAST(event_id % 7 AS DOUBLE) / 2 AS rain, CAST(event_id % 90 AS INTEGER) AS code FROM both_ WHERE event_id % 10 <> 0"),
    "a23_air_quality": _sql(f"""SELECT 'P' || event_id AS parameter, strftime(CASE WHEN event_id % 3 = 0 THEN arrival_at ELSE polled_at END, '%Y-%m-%d') AS day, event_id % 3 = 0 AS is_forecast, CAST(event_id % 200 AS INTEGER) AS aqi, CAST(event_id % 6 AS INTEGER) AS category,
      event_id % 3 = 0 AS action_day FROM both_"""),
    "a24_sports": _sql(f"""SELECT {ID} AS event_id, {MINUTE} AS starts_at, CASE WHEN delayed THEN 'in' ELSE 'post' END AS state, NOT delayed AS completed, 'Park ' || station AS venue, CAST(event_id % 1000 AS INTEGER) AS attendance, line AS home, 'T' || station AS away,
      CAST(event_id % 9 AS INTEGER) AS home_score, CAST(event_id % 7 AS INTEGER) AS away_score FROM both_"""),
    "a25_venues": _sql(f"SELECT {ID} AS event_id, line AS name, {SECOND} AS starts_at, 'Hall ' || station AS venue, CASE WHEN event_id % 4 <> 0 THEN 'Music' ELSE 'none' END AS kind FROM both_"),
    "a26_social": _sql(f"SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS network, CASE WHEN event_id % 2 = 0 THEN 'at://' || event_id ELSE {ID} END AS post_id, line AS author, CASE WHEN event_id % 2 = 0 THEN 'late ' ELSE 'stuck ' END || run AS text, {SECOND} AS at FROM both_"),
    "a27_traffic": _sql(f"SELECT CASE WHEN event_id % 2 = 0 THEN 'segment' ELSE 'region' END AS kind, {ID} AS place_id, line AS name, CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE event_id % 60 END::DOUBLE AS speed_mph, {SECOND} AS at FROM both_"),
    "a28_open_data": _sql(f"""SELECT event_id // {TOGETHER} AS poll_id, CASE WHEN event_id % 3 <> 0 THEN {ID} ELSE sha256('{{"number":' || event_id || ',"kind":"' || line || '"}}') END AS record_id, event_id AS number, line AS kind FROM both_"""),
    "a36_catalogue": """WITH st AS (SELECT s_suppkey AS map_id, 'Stop ' || (s_suppkey % 37) AS name FROM supplier), served AS (SELECT map_id, name, 'Red' AS line FROM st WHERE map_id % 2 = 0 UNION ALL SELECT map_id, name, 'Blue' FROM st WHERE map_id % 3 = 0 UNION ALL SELECT map_id, name, 'Pink' FROM st WHERE map_id % 5 = 0)
      SELECT map_id, name, line, first_id FROM served JOIN (SELECT name, min(map_id) AS first_id FROM st GROUP BY name) USING (name)""",
}
