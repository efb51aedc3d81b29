"""Detours: typed rows out of payloads, which of them are active, and what they do to stops and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcast.sources.ingest import clock, object_or_list

DETOUR = "STRUCT<id: STRING, ver: STRING, st: STRING, `desc`: STRING, rtdirs: STRING, startdt: STRING, enddt: STRING, moddt: STRING, ptrs: STRING, trips: STRING, dtrstartstop: STRING, dtrendstop: STRING, repstops: STRING>"
ROUTE = "STRUCT<rt: STRING, dir: STRING>"
PAIR = "STRUCT<origpid: STRING, dtrpid: STRING, dtrdelay: STRING>"
TRIP = "STRUCT<tripid: STRING, tatripid: STRING, origtatripno: STRING, stst: STRING>"
STOP = "STRUCT<stpid: STRING, stpnm: STRING, seq: STRING, lat: STRING, lon: STRING, adhoc: STRING, relpasstime: STRING>"
#: Dynamic action codes that keep a bus from serving a stop, and the code of a stop for getting off only.
SEVERE = (1, 4, 12, 16, 17, 18)
DISCHARGE_ONLY = 2


def detours(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Detours of ``{bustime-response: {dtrs: [...]}}``: ``detour_pk`` (id:version), state, times, and ``routes``, an array
    of (rt, dir). Rows without an id are left out; the children stay as text for the functions below."""
    head = F.from_json(body, "STRUCT<`bustime-response`: STRUCT<dtrs: STRING>>")["bustime-response"]["dtrs"]
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(object_or_list(head, DETOUR)).alias("d")).where("trim(d.id) <> ''")
    version = F.col("d.ver").try_cast("int")
    return rows.select(
        *keep, F.concat_ws(":", F.trim("d.id"), F.coalesce(version.cast("string"), F.lit(""))).alias("detour_pk"), F.trim("d.id").alias("id"), version.alias("ver"), F.col("d.st").try_cast("int").alias("state"), F.col("d.desc").alias("descr"),
        object_or_list(F.col("d.rtdirs"), ROUTE).alias("routes"), clock(F.col("d.startdt")).alias("starts_at"), clock(F.col("d.enddt")).alias("ends_at"),
        F.struct("d.ptrs", "d.trips", "d.dtrstartstop", "d.dtrendstop", "d.repstops").alias("children"),
    )


def newest_detours(rows: DataFrame, order: str) -> DataFrame:
    """One row per detour and version, the one seen last; ``first_seen`` and ``last_seen`` by ``order``."""
    by = rows.groupBy("detour_pk").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "detour_pk"]), order).alias("r"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    return by.select("detour_pk", "r.*", "first_seen", "last_seen")


def detour_patterns(rows: DataFrame) -> DataFrame:
    """Pattern pairs of detours: the original pattern, the one driven instead, and the delay; both ids are needed."""
    each = rows.select("detour_pk", F.explode(object_or_list(F.col("children.ptrs"), PAIR)).alias("p"))
    made = each.select("detour_pk", F.col("p.origpid").try_cast("int").alias("origpid"), F.col("p.dtrpid").try_cast("int").alias("dtrpid"), F.col("p.dtrdelay").try_cast("int").alias("delay_s"))
    return made.where("origpid is not null and dtrpid is not null")


def detour_trips(rows: DataFrame) -> DataFrame:
    each = rows.select("detour_pk", F.explode(object_or_list(F.col("children.trips"), TRIP)).alias("t"))
    return each.select("detour_pk", "t.tripid", "t.tatripid", "t.origtatripno", F.col("t.stst").try_cast("int").alias("stst"))


def detour_stops(rows: DataFrame) -> DataFrame:
    """Stops of detours by ``role``: where it starts, where it ends, and replacements in between."""
    child = lambda role, name: F.transform(object_or_list(F.col(f"children.{name}"), STOP), lambda s: F.struct(F.lit(role).alias("role"), s.alias("s")))
    each = rows.select("detour_pk", F.explode(F.concat(child("start", "dtrstartstop"), child("end", "dtrendstop"), child("replacement", "repstops"))).alias("c"))
    s = lambda name, kind: F.col(f"c.s.{name}").try_cast(kind)
    return each.select("detour_pk", "c.role", "c.s.stpid", "c.s.stpnm", F.coalesce(s("seq", "int"), F.lit(0)).alias("seq"), s("lat", "double").alias("lat"), s("lon", "double").alias("lon"), s("relpasstime", "int").alias("relpasstime_s"))


def active_routes(rows: DataFrame) -> DataFrame:
    """Lower-cased (rt, dir) that an active detour (state 1) names, each once."""
    each = rows.where("state = 1").select(F.explode("routes").alias("r"))
    return each.select(F.lower("r.rt").alias("rt"), F.lower("r.dir").alias("dir")).where("rt is not null").distinct()


def on_detour(rows: DataFrame, active: DataFrame, route: Column, direction: Column) -> DataFrame:
    """``rows`` with ``detour_active``: an active detour names the route and, where the row has one, the direction."""
    exact = active.select(F.col("rt").alias("__rt"), F.col("dir").alias("__dir")).distinct().withColumn("__exact", F.lit(True))
    whole = active.select(F.col("rt").alias("__any")).distinct().withColumn("__whole", F.lit(True))
    marked = rows.withColumns({"__route": F.lower(route), "__way": F.lower(direction)})
    joined = marked.join(exact, (F.col("__route") == F.col("__rt")) & (F.col("__way") == F.col("__dir")), "left").join(whole, F.col("__route") == F.col("__any"), "left")
    found = F.when(F.col("__way").isNull(), F.col("__whole")).otherwise(F.col("__exact"))
    return joined.withColumn("detour_active", F.coalesce(found, F.lit(False))).drop("__route", "__way", "__rt", "__dir", "__exact", "__any", "__whole")


def stop_changes(stops: DataFrame, rows: DataFrame) -> DataFrame:
    """``stops`` (stpid, added, removed: arrays of detour ids) with ``stop_added`` and ``stop_removed`` by an active detour.

    An array-membership join: ids are exploded and met by equality, then put together again by stop.
    """
    active = rows.where("state = 1").select(F.upper("id").alias("__id")).distinct()

    def named(column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(F.upper(x).alias("id"), F.lit(column).alias("how")))

    each = stops.select("stpid", F.explode(F.concat(named("added"), named("removed"))).alias("e"))
    hit = each.join(active, F.col("e.id") == F.col("__id")).groupBy("stpid").agg(F.bool_or(F.col("e.how") == "added").alias("__a"), F.bool_or(F.col("e.how") == "removed").alias("__r"))
    return stops.join(hit, "stpid", "left").withColumns({"stop_added": F.coalesce("__a", F.lit(False)), "stop_removed": F.coalesce("__r", F.lit(False))}).drop("__a", "__r")


def group_severity(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Per prediction group the largest dynamic code and flag-stop code, whether any code was severe, and the reasons."""
    severe = F.bool_or(F.col("dyn").isin(*SEVERE))
    out = F.bool_or(F.col("flagstop") == DISCHARGE_ONLY)
    by = predictions.groupBy(*keys).agg(F.max("dyn").alias("max_dyn"), F.max("flagstop").alias("max_flagstop"), F.coalesce(severe, F.lit(False)).alias("severe"), F.coalesce(out, F.lit(False)).alias("__out"), F.bool_or("delayed").alias("__late"))
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("__late"), "delayed"), F.when(F.col("__out"), "discharge_only"), F.when(F.col("severe"), "severe_dyn"))), ",")
    return by.withColumn("reasons", reasons).drop("__out", "__late")


def pattern_choice(vehicles: DataFrame, patterns: DataFrame) -> DataFrame:
    """The pattern of each vehicle row: its own if known, else the longest of its route and direction, ties to the least id."""
    best = patterns.groupBy("rt", "rtdir").agg(F.max_by("pid", F.struct("length_ft", -F.col("pid"))).alias("__best"))
    known = patterns.select(F.col("pid").alias("__pid")).distinct()
    rows = vehicles.join(known, F.col("pid") == F.col("__pid"), "left").join(best, ["rt", "rtdir"], "left")
    return rows.withColumn("pattern", F.coalesce("__pid", "__best")).drop("__pid", "__best")
