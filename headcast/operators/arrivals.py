"""When vehicles really arrived: evidence from snapshots, transitions and crossings, and what forecasts resolve to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.functions.geo import EARTH_M, bearing_deg, heading_error, segment_projection
from headcast.operators.joins import band_join, forward_asof, seconds_of


def observed_runs(arrivals: DataFrame, positions: DataFrame | None, now: Column) -> DataFrame:
    """One observed arrival per (line, run, station), from the strongest evidence there is.

    An approaching position counts most, then an approaching prediction, then the last prediction whose time has
    passed. Both streams go through one union and one aggregate; the prediction side ignores rows with a known fault
    or an unknown one.
    """
    none_ts, none_b = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("boolean")
    parts = arrivals.where(~F.col("fault")).select("line", "run", "station", "polled_at", "arrival_at", "approaching", "direction_code", F.lit(1).alias("from_arrivals"))
    if positions is not None:
        moved = positions.where(F.col("station").isNotNull()).select("line", "run", "station", "polled_at", none_ts.alias("arrival_at"), "approaching", "direction_code", F.lit(0).alias("from_arrivals"))
        parts = parts.unionByName(moved)
    a, near, past = F.col("from_arrivals") == 1, F.coalesce("approaching", F.lit(False)), F.col("arrival_at") <= now
    # ties of the poll time are settled by the predicted time, so that the row taken doesn't depend on partitioning
    when = F.struct("polled_at", "arrival_at", "direction_code")
    at = lambda value, cond: F.max_by(value, F.when(cond, when))
    by = parts.groupBy("line", "run", "station").agg(
        F.max(F.when(~a & near, F.col("polled_at"))).alias("p1"), at(F.col("arrival_at"), a & near).alias("p2"), at(F.col("arrival_at"), a & past).alias("p3"),
        at(F.col("direction_code"), ~a & (F.coalesce("direction_code", F.lit("")) != "")).alias("d0"), at(F.col("direction_code"), a & (F.coalesce("direction_code", F.lit("")) != "")).alias("d1"),
        F.min("polled_at").alias("first_seen_at"), F.max("polled_at").alias("last_seen_at"), F.count("*").alias("sample_count"),
    )
    prefix = "" if positions is None else "arrivals:"
    source = F.when(F.col("p1").isNotNull(), "positions:approaching").when(F.col("p2").isNotNull(), f"{prefix}approaching").when(F.col("p3").isNotNull(), f"{prefix}dropoff")
    return by.select("line", "run", "station", F.coalesce("p1", "p2", "p3").alias("observed_at"), source.alias("inferred_from"), F.coalesce("d0", "d1").alias("direction_code"), "first_seen_at", "last_seen_at", "sample_count").where("observed_at is not null")


def predicted_trips(arrivals: DataFrame, now: Column, keys: Sequence[str] = ("line", "run", "station")) -> DataFrame:
    """Arrivals of feeds that only predict: the largest predicted time of each group, once it has passed."""
    by = arrivals.groupBy(*keys).agg(F.max("arrival_at").alias("observed_at"), F.min("polled_at").alias("first_seen_at"), F.max("polled_at").alias("last_seen_at"), F.count("*").alias("sample_count"))
    return by.where(F.col("observed_at") <= now)


def resolve_trips(requests: DataFrame, observed: DataFrame, horizon: float, first: int = 5, strict: bool = False, task_rows: int = 500_000) -> DataFrame:
    """Which of the next ``first`` boardings after ``leave_at`` is the first whose run later reaches the alighting stop.

    ``requests``: request_id, line, board, alight, leave_at. ``observed``: line, run, station, observed_at. ``strict``
    asks that alighting comes after boarding rather than with it. Requests without a match aren't returned. The rows are
    counted first: tasks grow in number with them, about ``task_rows`` in each, not in memory.
    """
    default = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, 1 + (first * requests.count() + observed.count()) // task_rows)
    boardings = observed.select("line", F.col("station").alias("board"), F.col("observed_at").alias("boarded_at"), F.col("run").alias("run"))
    five = forward_asof(requests, boardings, "request_id", ["line", "board"], seconds_of(F.col("leave_at")), seconds_of(F.col("boarded_at")), horizon, first, parts)
    ends = observed.select("line", "run", F.col("station").alias("alight"), F.col("observed_at").alias("alighted_at"))
    # times are whole microseconds: half of one more asks for a later time
    since = seconds_of(F.col("boarded_at")) + (5e-7 if strict else 0.0)
    rides = forward_asof(five.withColumnRenamed("nth", "boarding"), ends, "request_id", ["line", "run", "alight"], since, seconds_of(F.col("alighted_at")), None, 1, parts).drop("nth").withColumnRenamed("boarding", "nth")
    taken = rides.repartition(parts, "request_id").groupBy("request_id").agg(F.min_by(F.struct(*[c for c in rides.columns if c != "request_id"]), "nth").alias("r")).select("request_id", "r.*")
    t = {c: seconds_of(F.col(c)) for c in ("leave_at", "boarded_at", "alighted_at")}
    return taken.withColumns({"wait_s": t["boarded_at"] - t["leave_at"], "ride_s": t["alighted_at"] - t["boarded_at"], "total_s": t["alighted_at"] - t["leave_at"]})


def endpoint_signal(points: DataFrame, samples: DataFrame, window: float = 600.0, cap: float = 4.0) -> DataFrame:
    """Weight of the raw samples around each (point_id, line, station, at): approaching 1.5, plain 1, scheduled 0.5."""
    near, sched = F.coalesce("approaching", F.lit(False)), F.coalesce("scheduled", F.lit(False))
    weight = F.when(near, 1.5).otherwise(0.0) + F.when(~near & ~sched, 1.0).otherwise(0.0) + F.when(sched, 0.5).otherwise(0.0)
    hits = band_join(points, samples.select("line", "station", "polled_at", weight.alias("w")), ["line", "station"], seconds_of(F.col("at")), seconds_of(F.col("polled_at")), -window, window)
    by = hits.groupBy("point_id").agg(F.sum("w").alias("w"), F.count("*").alias("samples"))
    joined = points.select("point_id").join(by, "point_id", "left")
    return joined.select("point_id", F.least(F.coalesce("w", F.lit(0.0)), F.lit(cap)).alias("signal"), F.coalesce("samples", F.lit(0)).alias("samples"))


def truth_confidence(board_signal: Column, alight_signal: Column) -> Column:
    low = F.least(board_signal, alight_signal)
    missing = board_signal.isNull() | alight_signal.isNull()
    return F.when(missing, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), low / 4.0)))


def transitions(positions: DataFrame, keys: Sequence[str] = ("line", "run"), at: str = "polled_at", tie: str = "event_id") -> DataFrame:
    """Consecutive positions of a run with different next stations: from, to, both times."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    cols = {"to_station": F.lead("station").over(order), "to_at": F.lead(at).over(order), "to_fault": F.lead("fault").over(order), "to_direction": F.lead("direction_code").over(order)}
    return positions.withColumns(cols).where((F.col("to_station") != F.col("station")) & F.col("to_station").isNotNull())


def transition_events(positions: DataFrame, gap_limit: float = 300.0) -> DataFrame:
    """Arrivals between two positions with different next stations, with label and confidence.

    Later rules overrule earlier labels: a fault, then a long gap (only while still confirmed), then a changed
    direction of travel.
    """
    t0, t1 = seconds_of(F.col("polled_at")), seconds_of(F.col("to_at"))
    pairs = transitions(positions).where(t1 > t0)
    fault = F.coalesce("fault", F.lit(False)) | F.coalesce("to_fault", F.lit(False))
    gap, turned = (t1 - t0) > gap_limit, ~F.col("direction_code").eqNullSafe(F.col("to_direction"))
    confidence = F.when(turned, F.least(F.when(fault, 0.20).when(gap, 0.40).otherwise(0.95), F.lit(0.25))).when(fault, 0.20).when(gap, 0.40).otherwise(0.95)
    label = F.when(turned, "REROUTED_OR_SHORT_TURN").when(fault, "FAULTED_TRACKING").when(gap, "CENSORED_UNKNOWN").otherwise("CONFIRMED_ARRIVAL")
    reasons = F.array_sort(F.array_compact(F.array(F.when(fault, "fault"), F.when(gap, "long_gap"), F.when(turned, "direction_changed"))))
    return pairs.select(
        "line", "run", "station", "to_station", F.floor((t0 + t1) / 2).cast("long").alias("event_s"), label.alias("label"), confidence.alias("confidence"), F.array_join(reasons, ",").alias("reasons")
    )


def spaced(events: DataFrame, keys: Sequence[str], at: str, spacing: int = 30) -> DataFrame:
    """Events at least over ``spacing`` after the last kept one of their key.

    Rows are dealt by key, sorted and streamed: a task remembers the last kept time, however long a burst is. Of events
    at one time the least is kept.
    """
    least = F.struct(*[c for c in events.columns if c not in (*keys, at)])
    distinct = events.groupBy(*keys, at).agg(F.min(least).alias("__r")).select(*keys, at, "__r.*")
    dealt = distinct.withColumn("__key", F.xxhash64(*keys)).repartition("__key").sortWithinPartitions("__key", *keys, at)
    names, place, times = distinct.columns, len(keys), distinct.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for batch in batches:
            wanted = []
            for row, (key, now) in enumerate(zip(zip(*[c.to_pylist() for c in batch.columns[:place]]), batch.column(times).to_pylist())):
                if key != last_key or now - last > spacing:
                    wanted.append(row)
                    last_key, last = key, now
            yield pa.RecordBatch.from_arrays([c.take(pa.array(wanted, pa.int64())) for c in batch.columns[: len(names)]], names=names)

    return dealt.mapInArrow(run, distinct.schema)


def topology_edges(positions: DataFrame, least: int = 3) -> DataFrame:
    """How often runs went from one next station to another, for pairs seen at least ``least`` times."""
    edges = transitions(positions).groupBy("line", "direction_code", F.col("station").alias("src"), F.col("to_station").alias("dst")).agg(F.count("*").alias("n"))
    return edges.where(F.col("n") >= least)


def topology_order(edges: DataFrame) -> DataFrame:
    """Stations of each (line, direction) in topological order, ties by id; what lies on cycles follows in id order.

    A line has tens of stations, so its graph is one small group; lines are ordered in parallel.
    """

    def order(group: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        indegree = {s: 0 for s in {*group.src, *group.dst}}
        for src, dst in zip(group.src, group.dst):
            out.setdefault(src, []).append(dst)
            indegree[dst] += 1
        ready, done = sorted(s for s, n in indegree.items() if not n), []
        while ready:
            s = ready.pop(0)
            done.append(s)
            for t in out.get(s, ()):
                indegree[t] -= 1
                if not indegree[t]:
                    ready.append(t)
            ready.sort()
        done += sorted(set(indegree) - set(done))
        return pd.DataFrame({"line": group.line.iloc[0], "direction_code": group.direction_code.iloc[0], "station": done, "seq": range(len(done))})

    return edges.groupBy("line", "direction_code").applyInPandas(order, "line string, direction_code string, station long, seq long")


def segments(points: DataFrame, pid: str = "pid") -> DataFrame:
    """Pieces of each polyline: consecutive points with coordinates."""
    order = Window.partitionBy(pid).orderBy("seq")
    nxt = {f"{c}2": F.lead(c).over(order) for c in ("lat", "lon", "pdist")}
    return points.withColumns(nxt).where("lat2 is not null").select(pid, "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("pdist").alias("pdist1"), "lat2", "lon2", "pdist2")


def map_match(vehicles: DataFrame, points: DataFrame, id_col: str = "vehicle_row") -> DataFrame:
    """The polyline piece nearest to each vehicle, its heading counting with 0.4 a degree; first piece on ties.

    ``vehicles``: id, pid, lat, lon, heading (may be null). Polylines are dimension data and are joined on their id.
    """
    pieces = vehicles.join(segments(points), "pid")
    t, distance = segment_projection(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    error = heading_error(F.col("heading"), bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    scored = pieces.withColumns({"__t": t, "distance_m": distance, "heading_err": error})
    score = F.col("distance_m") + F.coalesce(0.4 * F.col("heading_err"), F.lit(0.0))
    best = scored.groupBy(id_col).agg(F.min_by(F.struct("seq", "distance_m", "heading_err", (F.col("pdist1") + F.col("__t") * (F.col("pdist2") - F.col("pdist1"))).alias("projected")), F.struct(F.round(score, 6), "seq")).alias("m"))
    d, e = F.col("m.distance_m"), F.col("m.heading_err")
    quality = F.when((d <= 50) & (e.isNull() | (e <= 90)), "HIGH").when((d <= 100) & (e.isNull() | (e <= 120)), "MEDIUM").when(d <= 200, "LOW").otherwise("UNUSABLE")
    return best.select(id_col, F.col("m.seq").alias("seq"), d.alias("distance_m"), e.alias("heading_err"), F.col("m.projected").alias("projected"), quality.alias("quality"))


def crossings(observations: DataFrame, stops: DataFrame, max_gap: float = 120.0, speed: tuple[float, float] = (0.2, 110.0)) -> DataFrame:
    """First bracketed passing of each stop by each vehicle, interpolated between two observations.

    A vehicle that stands or goes back passes nothing.
    ``observations``: vid, pid, at_s (seconds), pdist, age_s (may be null), event_id. ``stops``: pid, stop, stop_pdist.
    """
    order = Window.partitionBy("vid").orderBy("at_s", "event_id")
    nxt = {f"{c}1": F.lead(c).over(order) for c in ("pid", "at_s", "pdist", "age_s")}
    pairs = observations.withColumns(nxt).where((F.col("pid") == F.col("pid1")))
    dt, dp = F.col("at_s1") - F.col("at_s"), F.col("pdist1") - F.col("pdist")
    fresh = (F.coalesce("age_s", F.lit(0.0)) <= 90) & (F.coalesce("age_s1", F.lit(0.0)) <= 90)
    usable = pairs.where((dt > 0) & (dp > 0) & (dt <= max_gap) & fresh).where((dp / dt).between(*speed))
    passed = usable.join(stops, "pid").where(F.col("stop_pdist").between(F.col("pdist"), F.col("pdist1")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("stop_pdist") - F.col("pdist")) / dp))
    at = F.floor(F.col("at_s") + share * dt).cast("long")
    return passed.groupBy("vid", "pid", "stop").agg(F.min_by(F.struct(at.alias("arrival_s"), (dp / dt).alias("speed")), F.struct("at_s", "event_id")).alias("c")).select("vid", "pid", "stop", F.col("c.arrival_s").alias("arrival_s"), F.round("c.speed", 6).alias("speed"))


def link_vehicles(left: DataFrame, right: DataFrame, max_m: float = 250.0, max_s: float = 90.0, least: int = 2, block: int = 1_000_000) -> DataFrame:
    """Runs of one stream and vehicles of another that were close in time and place at least ``least`` times.

    ``left``: line, run, lat, lon, at; ``right``: line, vehicle, lat2, lon2, at2. Both are dealt by line and stretch of time (a
    right row to the two whose windows can reach it). A task holds the rows of one stretch, measures distances in blocks of
    arrays, about ``block`` at once, and gives out what each run and vehicle sum up to: no pair leaves it.
    """
    width = 2 * max_s + 1
    at, at2 = seconds_of(F.col("at")), seconds_of(F.col("at2"))
    asked = left.where("line is not null and lat is not null and lon is not null").select("line", F.floor((at - max_s) / width).alias("bin"), at.alias("t"), "run", F.radians("lat").alias("y"), F.radians("lon").alias("x")).where("t is not null")
    own = F.floor(at2 / width)
    seen = right.where("line is not null and lat2 is not null and lon2 is not null").select("line", F.explode(F.array(own, own - 1)).alias("bin"), at2.alias("t"), "vehicle", F.radians("lat2").alias("y"), F.radians("lon2").alias("x")).where("t is not null")
    schema = T.StructType([left.schema["line"], left.schema["run"], right.schema["vehicle"], *T.StructType.fromDDL("n bigint, total double, top double")])
    reach = max_m / EARTH_M * (1 + 1e-9)

    def measure(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or seen.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in schema})
        seen = seen.sort_values("t", kind="stable")
        (run, runs), (vehicle, vehicles) = (pd.factorize(c, use_na_sentinel=False) for c in (asked["run"], seen["vehicle"]))
        t, y, x = (asked[c].to_numpy() for c in ("t", "y", "x"))
        t2, y2, x2 = (seen[c].to_numpy() for c in ("t", "y", "x"))
        low, high = np.searchsorted(t2, t - max_s, "left"), np.searchsorted(t2, t + max_s, "right")
        before, parts, i = np.concatenate([[0], np.cumsum(high - low)]), [], 0
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(before, before[i] + block, "right")) - 1)
            n = high[i:j] - low[i:j]
            a = np.repeat(np.arange(i, j), n)
            b = np.arange(len(a)) + np.repeat(low[i:j] - (before[i:j] - before[i]), n)
            # what lies too far north or south is out before anything else is measured
            near = np.abs(y2[b] - y[a]) <= reach
            a, b, i = a[near], b[near], j
            h = np.sin((y2[b] - y[a]) / 2) ** 2 + np.cos(y[a]) * np.cos(y2[b]) * np.sin((x2[b] - x[a]) / 2) ** 2
            d = 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
            close = d <= max_m
            d, (pair, place) = d[close], np.unique(run[a[close]] * len(vehicles) + vehicle[b[close]], return_inverse=True)
            top = np.zeros(len(pair))
            np.maximum.at(top, place, d)
            parts.append(pd.DataFrame({"run": runs[pair // len(vehicles)], "vehicle": vehicles[pair % len(vehicles)], "n": np.bincount(place, minlength=len(pair)), "total": np.bincount(place, d, len(pair)), "top": top}))
        return pd.concat(parts).assign(line=asked["line"].iloc[0]).astype({c: "object" for c in ("line", "run", "vehicle")})[[f.name for f in schema]]

    sums = asked.groupBy("line", "bin").cogroup(seen.groupBy("line", "bin")).applyInPandas(measure, schema)
    by = sums.groupBy("line", "run", "vehicle").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("top").alias("top"))
    return by.where(F.col("n") >= least).select("line", "run", "vehicle", "n", F.round("mean", 3).alias("mean_m"), F.round("top", 3).alias("max_m"))
