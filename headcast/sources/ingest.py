"""Typed rows out of archived payloads: JSON text in, silver rows out, without a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETA = "STRUCT<staId: STRING, stpId: STRING, rn: STRING, rt: STRING, prdt: STRING, arrT: STRING, isApp: STRING, isDly: STRING, isFlt: STRING, isSch: STRING, trDr: STRING, destNm: STRING>"
TRAIN = "STRUCT<`@name`: STRING, train: STRING>"
POSITION = "STRUCT<rn: STRING, nextStaId: STRING, nextStaNm: STRING, prdt: STRING, arrT: STRING, isApp: STRING, isDly: STRING, lat: STRING, lon: STRING, heading: STRING, trDr: STRING, destNm: STRING>"


def object_or_list(text: Column, item: str) -> Column:
    """An array from JSON text that holds a list of ``item``, one ``item``, or nothing."""
    trimmed = F.ltrim(text)
    return F.when(trimmed.startswith("["), F.from_json(trimmed, f"ARRAY<{item}>")).when(trimmed.startswith("{"), F.array(F.from_json(trimmed, item))).otherwise(F.array().cast(f"ARRAY<{item}>"))


def flag(text: Column) -> Column:
    """'1'/'0' and words for yes and no; anything else is unknown."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "t", "yes", "y"), True).when(low.isin("0", "false", "f", "no", "n"), False)


def clock(text: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyyMMdd HH:mm")) -> Column:
    """Timestamp of the first format that fits, or of epoch seconds or milliseconds; null otherwise."""
    digits = F.when(text.rlike("^[0-9]{9,14}$"), text.try_cast("bigint"))
    millis = F.when(digits < 10_000_000_000, digits * 1000).otherwise(digits)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries, F.timestamp_millis(millis))


def countdown(text: Column) -> Column:
    """Minutes of a countdown: due is 0, delayed is unknown."""
    up = F.upper(F.trim(text))
    return F.when(up == "DUE", 0.0).when(up == "DLY", None).otherwise(up.try_cast("double"))


def train_arrivals(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Arrivals of ``{ctatt: {tmst, errCd, eta: [...]}}``. Payloads with an error code, and rows without ids or a time, are left out."""
    head = F.from_json(body, "STRUCT<ctatt: STRUCT<tmst: STRING, errCd: STRING, eta: STRING>>")["ctatt"]
    rows = payloads.select(*[c for c in payloads.columns if c != body], head.alias("h")).where("h.errCd is null or h.errCd = '0'")
    eta = rows.select(*[c for c in rows.columns if c != "h"], F.col("h.tmst").alias("tmst"), F.explode(object_or_list(F.col("h.eta"), ETA)).alias("e"))
    out = eta.select(
        *[c for c in eta.columns if c not in ("tmst", "e")], F.col("e.rt").alias("line"), F.col("e.rn").alias("run"), F.col("e.staId").try_cast("int").alias("station"), clock(F.col("tmst")).alias("server_at"), clock(F.col("e.prdt")).alias("predicted_at"),
        clock(F.col("e.arrT")).alias("arrival_at"), flag(F.col("e.isApp")).alias("approaching"), flag(F.col("e.isDly")).alias("delayed"), flag(F.col("e.isFlt")).alias("fault"), flag(F.col("e.isSch")).alias("scheduled"), F.col("e.trDr").alias("direction_code"), F.col("e.destNm").alias("destination"),
    ).where("line is not null and run is not null and station is not null and arrival_at is not null and predicted_at is not null")
    age = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return out.withColumns({"eta_s": age(F.col("arrival_at"), F.col("server_at")), "prediction_age_s": age(F.col("server_at"), F.col("predicted_at"))})


def train_positions(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Positions of ``{ctatt: {route: [{@name, train: [...]}]}}``; routes and trains may be single objects."""
    head = F.from_json(body, "STRUCT<ctatt: STRUCT<tmst: STRING, errCd: STRING, route: STRING>>")["ctatt"]
    rows = payloads.select(*[c for c in payloads.columns if c != body], head.alias("h")).where("h.errCd is null or h.errCd = '0'")
    keep = [c for c in rows.columns if c != "h"]
    routes = rows.select(*keep, F.explode(object_or_list(F.col("h.route"), TRAIN)).alias("r"))
    trains = routes.select(*keep, F.col("r.`@name`").alias("line"), F.explode(object_or_list(F.col("r.train"), POSITION)).alias("p"))
    return trains.select(
        *keep, "line", F.col("p.rn").alias("run"), F.col("p.nextStaId").try_cast("int").alias("station"), F.col("p.nextStaNm").alias("station_name"), clock(F.col("p.arrT")).alias("arrival_at"), flag(F.col("p.isApp")).alias("approaching"),
        clock(F.col("p.prdt")).alias("predicted_at"), F.col("p.trDr").alias("direction_code"), F.col("p.destNm").alias("destination"), flag(F.col("p.isDly")).alias("delayed"), F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon"), F.col("p.heading").try_cast("double").alias("heading"),
    ).where("run is not null")


def bus_predictions(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Predictions of ``{bustime-response: {prd: [...]}}`` with countdown minutes; within a minute counts as approaching.

    If the payloads have a ``server_at`` time, the prediction's age and what is left until the arrival are given too.
    """
    item = "STRUCT<tmstmp: STRING, typ: STRING, stpid: STRING, stpnm: STRING, vid: STRING, dstp: STRING, rt: STRING, rtdir: STRING, des: STRING, prdtm: STRING, prdctdn: STRING, dly: STRING, dyn: STRING, tatripid: STRING, flagstop: STRING>"
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<prd: STRING>>")["bustime-response"]["prd"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, item)).alias("p"))
    minutes = countdown(F.col("p.prdctdn"))
    made = rows.select(
        *keep, F.col("p.rt").alias("line"), F.col("p.vid").alias("vehicle"), F.col("p.stpid").alias("stop"), clock(F.col("p.tmstmp")).alias("stamped_at"), clock(F.col("p.prdtm")).alias("arrival_at"), minutes.alias("minutes"),
        (F.coalesce(minutes, F.lit(99.0)) <= 1).alias("approaching"), flag(F.col("p.dly")).alias("delayed"), F.col("p.dstp").try_cast("double").alias("distance_ft"), F.coalesce(F.col("p.dyn").try_cast("int"), F.lit(0)).alias("dyn"),
        F.col("p.typ").alias("typ"), F.col("p.rtdir").alias("direction"), F.col("p.des").alias("destination"), F.col("p.tatripid").alias("trip"), F.col("p.flagstop").try_cast("int").alias("flagstop"),
    ).where("line is not null and stop is not null")
    return made.withColumns({"prediction_age_s": _seconds("server_at", "stamped_at"), "eta_s": _seconds("arrival_at", "server_at")}) if "server_at" in keep else made


def legacy_bus_predictions(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``bus_predictions`` of the older feed: a countdown that is missing or no number counts as 99 minutes."""
    return bus_predictions(payloads, body).withColumn("minutes", F.coalesce("minutes", F.lit(99.0)))


def _seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 1e6


def bus_vehicles(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Vehicle positions of ``{bustime-response: {vehicle: [...]}}`` with pattern and distance along it, and their age if the
    payloads have a ``server_at`` time."""
    item = "STRUCT<vid: STRING, tmstmp: STRING, lat: STRING, lon: STRING, hdg: STRING, pid: STRING, rt: STRING, pdist: STRING, dly: STRING>"
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<vehicle: STRING>>")["bustime-response"]["vehicle"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, item)).alias("v"))
    made = rows.select(
        *keep, F.col("v.vid").alias("vehicle"), F.col("v.rt").alias("line"), clock(F.col("v.tmstmp")).alias("stamped_at"), F.col("v.lat").try_cast("double").alias("lat"), F.col("v.lon").try_cast("double").alias("lon"), F.col("v.hdg").try_cast("double").alias("heading"),
        F.col("v.pid").try_cast("int").alias("pid"), F.col("v.pdist").try_cast("double").alias("pdist_ft"), flag(F.col("v.dly")).alias("delayed"),
    ).where("vehicle is not null")
    return made.withColumn("vehicle_age_s", _seconds("server_at", "stamped_at")) if "server_at" in keep else made


def train_follow(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Arrivals of one run, ``{ctatt: {tmst, errCd, eta: [...]}}``, with the order of its stops (``seq`` from 0)."""
    head = F.from_json(body, "STRUCT<ctatt: STRUCT<tmst: STRING, errCd: STRING, eta: STRING>>")["ctatt"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, head.alias("h")).where("h.errCd is null or h.errCd = '0'")
    each = rows.select(*keep, clock(F.col("h.tmst")).alias("server_at"), F.posexplode(object_or_list(F.col("h.eta"), ETA)).alias("seq", "e"))
    return each.select(
        *keep, "seq", F.col("e.rn").alias("run"), F.col("e.rt").alias("line"), F.col("e.staId").try_cast("int").alias("station"), clock(F.col("e.arrT")).alias("arrival_at"), flag(F.col("e.isApp")).alias("approaching"), "server_at"
    ).where("run is not null and station is not null").withColumn("eta_s", _seconds("arrival_at", "server_at"))


def bus_routes(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Routes of ``{bustime-response: {routes: [...]}}`` with their name and colour; rows without an id are left out."""
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<routes: STRING>>")["bustime-response"]["routes"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, "STRUCT<rt: STRING, rtnm: STRING, rtclr: STRING, rtdd: STRING>")).alias("r"))
    return rows.where("trim(r.rt) <> ''").select(*keep, F.trim("r.rt").alias("rt"), F.col("r.rtnm").alias("name"), F.col("r.rtclr").alias("colour"), F.col("r.rtdd").alias("shown_as"))


def bus_directions(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Directions of ``{bustime-response: {directions: [...]}}`` of a route: id and name, or one field for both."""
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<directions: STRING>>")["bustime-response"]["directions"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, "STRUCT<id: STRING, name: STRING, dir: STRING>")).alias("d"))
    ident = F.trim(F.coalesce("d.id", "d.dir", "d.name"))
    return rows.where(ident != "").select(*keep, ident.alias("direction"), F.coalesce("d.name", "d.dir", "d.id").alias("name"))


def bus_stops(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Stops of ``{bustime-response: {stops: [...]}}``; the route and direction asked for come with the payload."""
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<stops: STRING>>")["bustime-response"]["stops"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, "STRUCT<stpid: STRING, stpnm: STRING, lat: STRING, lon: STRING>")).alias("s"))
    number = lambda c: F.col(f"s.{c}").try_cast("double").alias(c)
    return rows.where("trim(s.stpid) <> ''").select(*keep, F.trim("s.stpid").alias("stop"), F.col("s.stpnm").alias("name"), number("lat"), number("lon"))


def bus_patterns(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Patterns of ``{bustime-response: {ptr: [...]}}`` with ``points``: of the pattern, and those it had before a detour."""
    point = "STRUCT<seq: STRING, typ: STRING, stpid: STRING, stpnm: STRING, lat: STRING, lon: STRING, pdist: STRING>"
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<ptr: STRING>>")["bustime-response"]["ptr"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, "STRUCT<pid: STRING, rtdir: STRING, ln: STRING, dtrid: STRING, pt: STRING, dtrpt: STRING>")).alias("p"))
    marked = lambda name, original: F.transform(object_or_list(F.col(f"p.{name}"), point), lambda x: F.struct(x.alias("x"), F.lit(original).alias("original")))
    made = rows.select(*keep, F.col("p.pid").try_cast("int").alias("pid"), F.col("p.rtdir").alias("rtdir"), F.col("p.ln").try_cast("double").alias("length_ft"), F.col("p.dtrid").alias("detour"), F.concat(marked("pt", False), marked("dtrpt", True)).alias("points"))
    return made.where("pid is not null")


def bus_pattern_points(patterns: DataFrame) -> DataFrame:
    """The points of ``bus_patterns``, one row each; points without a place in the order are left out."""
    each = patterns.select("pid", F.explode("points").alias("p"))
    value = lambda name, kind: F.col(f"p.x.{name}").try_cast(kind)
    made = each.select("pid", value("seq", "int").alias("seq"), F.col("p.original").alias("is_original"), F.col("p.x.typ").alias("typ"), F.col("p.x.stpid").alias("stop"), value("lat", "double").alias("lat"), value("lon", "double").alias("lon"), value("pdist", "double").alias("pdist_ft"))
    return made.where("seq is not null")


def bus_errors(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Error objects of a payload, one row each."""
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<error: STRING>>")["bustime-response"]["error"]
    keep = [c for c in payloads.columns if c != body]
    return payloads.select(*keep, F.explode(object_or_list(head, "STRUCT<msg: STRING, rt: STRING, stpid: STRING>")).alias("e")).select(*keep, "e.*")


def trip_updates(payloads: DataFrame, body: str = "body", late: float = 60.0) -> DataFrame:
    """Stop times of feed messages in JSON form; departure before arrival, times only if above zero."""
    event = "STRUCT<time: BIGINT, delay: INT, uncertainty: INT>"
    kind = f"STRUCT<header: STRUCT<timestamp: BIGINT>, entity: ARRAY<STRUCT<id: STRING, trip_update: STRUCT<trip: STRUCT<trip_id: STRING, route_id: STRING, direction_id: INT>, vehicle: STRUCT<id: STRING>, stop_time_update: ARRAY<STRUCT<stop_sequence: INT, stop_id: STRING, arrival: {event}, departure: {event}>>>>>>"
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.from_json(body, kind).alias("m")).select(*keep, F.col("m.header.timestamp").alias("feed_s"), F.explode("m.entity").alias("e"))
    stops = rows.select(*keep, "feed_s", F.col("e.trip_update").alias("u"), F.explode("e.trip_update.stop_time_update").alias("s"))
    time = F.coalesce(F.when(F.col("s.departure.time") > 0, F.col("s.departure.time")), F.when(F.col("s.arrival.time") > 0, F.col("s.arrival.time")))
    delay = F.coalesce("s.departure.delay", "s.arrival.delay")
    return stops.select(*keep, "feed_s", F.col("u.trip.trip_id").alias("trip_id"), F.col("u.trip.route_id").alias("line"), F.col("u.trip.direction_id").alias("direction_id"), F.col("u.vehicle.id").alias("vehicle"), F.col("s.stop_id").alias("stop"), F.col("s.stop_sequence").alias("seq"), time.alias("predicted_s"), delay.alias("delay_s"), (F.coalesce(delay, F.lit(0)) > late).alias("delayed"))


def static_table(spark, path: str, columns: dict[str, str]) -> DataFrame:
    """One file of a static schedule set: missing columns, empty texts and bad values become null; extra columns go."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    return raw.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).try_cast(kind) if c in raw.columns else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()])


def html_rows(pages: DataFrame, row_tag: str, cell_tag: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of cells by tag names: ``row`` (from 0) and ``cells`` (texts without markup, white space drawn together)."""
    rows = F.regexp_extract_all(html_col, F.lit(f"(?is)<{row_tag}\\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))
    each = pages.select(id_col, F.posexplode(rows).alias("row", "inner"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " "))
    return each.select(id_col, "row", F.transform(F.regexp_extract_all("inner", F.lit(f"(?is)<{cell_tag}\\b[^>]*>(.*?)</{cell_tag}>"), F.lit(1)), clean).alias("cells"))


def slow_zone_fields(text: Column, lines: Sequence[str] = ("Red", "Blue", "Brown", "Green", "Orange", "Pink", "Purple", "Yellow")) -> dict[str, Column]:
    """Line, speed and both stations out of a row's text; null where it doesn't say."""
    line = F.initcap(F.nullif(F.regexp_extract(text, f"(?i)\\b({'|'.join(lines)})\\b", 1), F.lit("")))
    between = "(?i)between\\s+(.+?)\\s+and\\s+(.+?)(?:[,;.|]|$)"
    return {
        "line": line, "mph": F.nullif(F.regexp_extract(text, "(?i)(\\d{1,2})\\s*mph", 1), F.lit("")).try_cast("int"),
        "from_station": F.nullif(F.regexp_extract(text, between, 1), F.lit("")), "to_station": F.nullif(F.regexp_extract(text, between, 2), F.lit("")),
    }
