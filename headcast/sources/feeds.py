"""Context feeds and schedule feeds out of archived JSON bodies, one function per kind. No Python worker is involved.

Each takes a table of payloads with a text column ``body`` and carries its other columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcast.sources.ingest import clock, flag, object_or_list


def _rest(payloads: DataFrame, body: str) -> list[str]:
    return [c for c in payloads.columns if c != body]


def _items(payloads: DataFrame, body: str, path: str, item: str) -> tuple[DataFrame, list[str]]:
    """Rows of the list (or single object) at a JSON path, as ``x``."""
    keep = _rest(payloads, body)
    return payloads.select(*keep, F.explode(object_or_list(F.get_json_object(body, path), item)).alias("x")), keep


def vehicle_positions(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Positions of a realtime feed in JSON form; carriages stay JSON text."""
    item = "STRUCT<id: STRING, vehicle: STRUCT<trip: STRUCT<trip_id: STRING, route_id: STRING>, vehicle: STRUCT<id: STRING, label: STRING>, position: STRUCT<latitude: DOUBLE, longitude: DOUBLE, bearing: DOUBLE>, current_status: STRING, congestion_level: STRING, occupancy_status: STRING, stop_id: STRING, `timestamp`: BIGINT, multi_carriage_details: STRING>>"
    rows, keep = _items(payloads, body, "$.entity", item)
    v = "x.vehicle"
    return rows.select(
        *keep, F.col(f"{v}.vehicle.id").alias("vehicle"), F.col(f"{v}.trip.trip_id").alias("trip_id"), F.col(f"{v}.trip.route_id").alias("line"), F.col(f"{v}.position.latitude").alias("lat"), F.col(f"{v}.position.longitude").alias("lon"), F.col(f"{v}.position.bearing").alias("heading"),
        F.lower(f"{v}.current_status").alias("status"), F.lower(f"{v}.congestion_level").alias("congestion"), F.lower(f"{v}.occupancy_status").alias("occupancy"), F.col(f"{v}.stop_id").alias("stop"), F.timestamp_seconds(f"{v}.timestamp").alias("at"), F.col(f"{v}.multi_carriage_details").alias("carriages"),
    ).where("vehicle is not null")


def realtime_alerts(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Alerts of a realtime feed: lower-cased cause, effect and severity, first translation, periods and entities as arrays."""
    text = "STRUCT<translation: ARRAY<STRUCT<text: STRING, language: STRING>>>"
    item = f"STRUCT<id: STRING, alert: STRUCT<cause: STRING, effect: STRING, severity_level: STRING, header_text: {text}, description_text: {text}, active_period: ARRAY<STRUCT<start: BIGINT, `end`: BIGINT>>, informed_entity: ARRAY<STRUCT<agency_id: STRING, route_id: STRING, stop_id: STRING>>>>"
    rows, keep = _items(payloads, body, "$.entity", item)
    a = "x.alert"
    return rows.where("x.alert is not null").select(
        *keep, F.col("x.id").alias("alert_id"), F.lower(f"{a}.cause").alias("cause"), F.lower(f"{a}.effect").alias("effect"), F.lower(f"{a}.severity_level").alias("severity"), F.get(f"{a}.header_text.translation", F.lit(0))["text"].alias("header"),
        F.get(f"{a}.description_text.translation", F.lit(0))["text"].alias("description"), F.col(f"{a}.active_period").alias("periods"), F.col(f"{a}.informed_entity").alias("entities"),
    )


def unwrapped(text: Column) -> Column:
    """Text of a field that may be an object with a CDATA section."""
    return F.coalesce(F.get_json_object(text, "$.#cdata-section"), text)


def service_alerts(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Alerts of the operator's own feed; impacted services stay JSON text."""
    item = "STRUCT<AlertId: STRING, Headline: STRING, ShortDescription: STRING, SeverityScore: STRING, Impact: STRING, EventStart: STRING, EventEnd: STRING, MajorAlert: STRING, ImpactedService: STRING>"
    rows, keep = _items(payloads, body, "$.CTAAlerts.Alert", item)
    return rows.select(
        *keep, F.col("x.AlertId").alias("alert_id"), unwrapped(F.col("x.Headline")).alias("headline"), unwrapped(F.col("x.ShortDescription")).alias("description"), F.col("x.SeverityScore").try_cast("int").alias("severity"), F.col("x.Impact").alias("impact"),
        clock(F.col("x.EventStart")).alias("starts_at"), clock(F.col("x.EventEnd")).alias("ends_at"), flag(F.col("x.MajorAlert")).alias("major"), F.col("x.ImpactedService").alias("services"),
    ).where("alert_id is not null")


def weather(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Current conditions: one row per payload that has any."""
    kind = "STRUCT<current: STRUCT<time: STRING, temperature_2m: DOUBLE, precipitation: DOUBLE, rain: DOUBLE, snowfall: DOUBLE, wind_speed_10m: DOUBLE, weather_code: INT>>"
    rows = payloads.select(*_rest(payloads, body), F.from_json(body, kind)["current"].alias("x")).where("x is not null")
    return rows.select(*_rest(payloads, body), clock(F.col("x.time"), ("yyyy-MM-dd'T'HH:mm",)).alias("at"), *[F.col(f"x.{c}").alias(n) for c, n in (("temperature_2m", "temperature"), ("precipitation", "precipitation"), ("rain", "rain"), ("snowfall", "snowfall"), ("wind_speed_10m", "wind_speed"), ("weather_code", "code"))])


def air_quality(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Observed and forecast indices: a row with ``DateForecast`` is a forecast, and its day the day acted on."""
    item = "STRUCT<DateObserved: STRING, DateForecast: STRING, ParameterName: STRING, AQI: INT, Category: STRUCT<Number: INT, Name: STRING>, ReportingArea: STRING, ActionDay: STRING>"
    rows, keep = _items(payloads, body, "$", item)
    day = F.trim(F.coalesce("x.DateForecast", "x.DateObserved"))
    return rows.select(*keep, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date").alias("day"), F.col("x.DateForecast").isNotNull().alias("is_forecast"), F.col("x.ParameterName").alias("parameter"), F.col("x.AQI").alias("aqi"), F.col("x.Category.Number").alias("category"), flag(F.col("x.ActionDay")).alias("action_day")).where("day is not null")


def sports_events(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Games with home and away sides out of the list of competitors."""
    side = "STRUCT<homeAway: STRING, score: STRING, team: STRUCT<displayName: STRING>>"
    item = f"STRUCT<id: STRING, date: STRING, name: STRING, status: STRUCT<type: STRUCT<state: STRING, completed: BOOLEAN>>, competitions: ARRAY<STRUCT<attendance: INT, venue: STRUCT<fullName: STRING>, competitors: ARRAY<{side}>>>>"
    rows, keep = _items(payloads, body, "$.events", item)
    first = F.get("x.competitions", F.lit(0))
    pick = lambda who: F.get(F.filter(first["competitors"], lambda c: c["homeAway"] == who), F.lit(0))
    return rows.select(
        *keep, F.col("x.id").alias("event_id"), clock(F.col("x.date"), ("yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm:ssX")).alias("starts_at"), F.col("x.name").alias("name"), F.col("x.status.type.state").alias("state"), F.col("x.status.type.completed").alias("completed"), first["venue"]["fullName"].alias("venue"),
        first["attendance"].alias("attendance"), pick("home")["team"]["displayName"].alias("home"), pick("away")["team"]["displayName"].alias("away"), pick("home")["score"].try_cast("int").alias("home_score"), pick("away")["score"].try_cast("int").alias("away_score"),
    ).where("event_id is not null")


def venue_events(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Shows with their first venue and first classification."""
    item = "STRUCT<id: STRING, name: STRING, dates: STRUCT<start: STRUCT<dateTime: STRING>>, classifications: ARRAY<STRUCT<segment: STRUCT<name: STRING>>>, _embedded: STRUCT<venues: ARRAY<STRUCT<name: STRING>>>>"
    rows, keep = _items(payloads, body, "$._embedded.events", item)
    return rows.select(*keep, F.col("x.id").alias("event_id"), F.col("x.name").alias("name"), clock(F.col("x.dates.start.dateTime"), ("yyyy-MM-dd'T'HH:mm:ssX",)).alias("starts_at"), F.get("x._embedded.venues", F.lit(0))["name"].alias("venue"), F.get("x.classifications", F.lit(0))["segment"]["name"].alias("kind")).where("event_id is not null")


def social_posts(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Posts of two networks in one schema: one lists them under ``posts``, the other under ``statuses``."""
    a, keep = _items(payloads, body, "$.posts", "STRUCT<uri: STRING, author: STRUCT<handle: STRING>, record: STRUCT<text: STRING, createdAt: STRING>>")
    b, _ = _items(payloads, body, "$.statuses", "STRUCT<id: STRING, account: STRUCT<acct: STRING>, content: STRING, created_at: STRING>")
    stamp = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX")
    one = a.select(*keep, F.lit("a").alias("network"), F.col("x.uri").alias("post_id"), F.col("x.author.handle").alias("author"), F.col("x.record.text").alias("text"), clock(F.col("x.record.createdAt"), stamp).alias("at"))
    two = b.select(*keep, F.lit("b").alias("network"), F.col("x.id").alias("post_id"), F.col("x.account.acct").alias("author"), F.trim(F.regexp_replace("x.content", "<[^>]*>", " ")).alias("text"), clock(F.col("x.created_at"), stamp).alias("at"))
    return one.unionByName(two)


def traffic(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Street segments and regions in one schema; names differ between the feeds."""
    item = "STRUCT<segmentid: STRING, segment_id: STRING, _region_id: STRING, region_id: STRING, street: STRING, region: STRING, _traffic: STRING, speed: STRING, current_speed: STRING, _last_updt: STRING, last_updated: STRING, time: STRING>"
    rows, keep = _items(payloads, body, "$", item)
    segment, region = F.coalesce("x.segmentid", "x.segment_id"), F.coalesce("x._region_id", "x.region_id")
    speed = F.coalesce("x._traffic", "x.speed", "x.current_speed").try_cast("double")
    return rows.select(
        *keep, F.when(segment.isNotNull(), "segment").when(region.isNotNull(), "region").alias("kind"), F.coalesce(segment, region).alias("place_id"), F.coalesce("x.street", "x.region").alias("name"), F.when(speed >= 0, speed).alias("speed_mph"),
        clock(F.coalesce("x._last_updt", "x.last_updated", "x.time"), ("yyyy-MM-dd HH:mm:ss.S", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")).alias("at"),
    ).where("place_id is not null")


def open_data(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per record, the whole record as JSON text, with its own id or else a hash of it."""
    keep = _rest(payloads, body)
    rows = payloads.select(*keep, F.explode(F.from_json(body, "ARRAY<STRING>")).alias("record"))
    return rows.select(*keep, F.coalesce(F.get_json_object("record", "$[':id']"), F.get_json_object("record", "$.id"), F.sha2("record", 256)).alias("record_id"), "record")


def station_catalogue(stations: DataFrame) -> dict[str, DataFrame]:
    """``by_line`` (a row per station and served line) and ``by_name`` (the first station of each name, by id).

    ``stations``: map_id, name, served_lines (array).
    """
    by_line = stations.select("map_id", "name", F.explode("served_lines").alias("line"))
    by_name = stations.groupBy("name").agg(F.min_by(F.struct(*[c for c in stations.columns if c != "name"]), "map_id").alias("s")).select("name", "s.*")
    return {"by_line": by_line, "by_name": by_name}


def monitored_targets(monitored: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What to poll: ``rt``, ``stpid`` and the direction's label where the catalogue (route, stop, direction_label) knows it.

    ``monitored``: route, stop; each pair once.
    """
    known = catalogue.groupBy(F.col("route").cast("string").alias("rt"), F.col("stop").cast("string").alias("stpid")).agg(F.min("direction_label").alias("direction"))
    pairs = monitored.select(F.col("route").cast("string").alias("rt"), F.col("stop").cast("string").alias("stpid")).distinct()
    return pairs.join(known, ["rt", "stpid"], "left")


def target_lists(targets: DataFrame) -> DataFrame:
    """One row: the different routes, stops and known directions of the targets, in order."""
    every = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return targets.agg(every("rt").alias("routes"), every("stpid").alias("stops"), every("direction").alias("directions"))


def station_targets(stations: DataFrame, lines: list[str]) -> DataFrame:
    """Stations (map_id, name, served_lines) that serve any of ``lines``, with those that they serve."""
    served = F.array_intersect("served_lines", F.array(*map(F.lit, lines)))
    return stations.select("map_id", "name", F.array_sort(served).alias("lines")).where(F.size("lines") > 0)
