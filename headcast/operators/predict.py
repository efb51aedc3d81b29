"""Waits, trips and the corridors that need a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcast.operators.joins import anti_null_safe, seconds_of
from headcast.operators.sliding import Departures, micros, over_windows

Z80, Z90 = 0.8416212335729143, 1.2815515655446004


def saturating(rate: Column, seconds: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-rate * seconds)))


def wait_forecasts(requests: DataFrame, departures: DataFrame, window: float, headway: Column | None = None) -> DataFrame:
    """Wait at a stop for each request (request_id, line, station, leave_at) from all departures of the ``window`` seconds after it.

    ``departures``: line, station, arrival_at, approaching; of several rows for one time an approaching one counts. Gaps and
    their medians are kept along one sorted stream per stop, however many departures a window holds. Without any, the
    scheduled headway gives half of it as the wait; without that too, nothing is known.
    """
    one = departures.groupBy("line", "station", "arrival_at").agg(F.max("approaching").alias("approaching"))
    rows = over_windows(requests, one, ["line", "station"], micros(F.col("leave_at")), micros(F.col("arrival_at")), 0, round(window * 1e6), Departures, ["approaching"])
    rows = rows.withColumns({"headway": headway if headway is not None else F.lit(None).cast("double"), "wait": (F.col("first_at") - micros(F.col("leave_at"))) / 1e6})
    w, live, scheduled = F.col("wait"), F.col("first_at").isNotNull(), F.coalesce("headway", F.lit(0.0)) > 0
    mean = F.when(live, w).when(scheduled, F.col("headway") / 2).otherwise(0.0)
    sigma = F.when(live & (F.col("n_gaps") <= 0), F.greatest(F.lit(60.0), 0.2 * w)).when(live, F.greatest(F.lit(45.0), 0.3 * F.col("gap"))).when(scheduled, F.col("headway") / 3).otherwise(0.0)
    confidence = F.when(live & (F.col("n_gaps") <= 0), 0.55).when(live, F.least(F.lit(1.0), 0.5 + 0.1 * F.least(F.col("n_gaps"), F.lit(4)))).when(scheduled, 0.4).otherwise(0.0)
    two = (F.col("n_gaps") >= 2) & (F.col("rest") > 0)
    state = (
        F.when(~live & scheduled, "feed_unreliable").when(~live, "unknown").when(F.coalesce("first_near", F.lit(False)) | (w <= 240), "good")
        .when(two & (F.col("first_gap") > 0) & (F.col("first_gap") < 0.5 * F.col("rest")) & (F.col("first_gap") <= 240), "bunched")
        .when((two & (F.col("first_gap") > 2 * F.col("rest")) & (F.col("first_gap") > 720)) | (w > 720), "bad_gap").when(w > 420, "risky").otherwise("acceptable")
    )
    rate = 1 / F.greatest(F.lit(60.0), F.col("headway") / 2)
    within = lambda s: F.when(live, (w <= s).cast("double")).when(scheduled, saturating(rate, s)).otherwise(0.0)
    return rows.select("request_id", mean.alias("mean"), sigma.alias("sigma"), confidence.alias("confidence"), state.alias("state"), within(300.0).alias("p_5min"), within(600.0).alias("p_10min"), within(900.0).alias("p_15min")).withColumns(gaussian(F.col("mean"), F.col("sigma")))


def gaussian(mean: Column, sigma: Column) -> dict[str, Column]:
    """Quantiles of a normal, kept at zero or more."""
    zero = F.lit(0.0)
    return {"p50": F.greatest(zero, mean), "p80": F.greatest(zero, mean + Z80 * sigma), "p90": F.greatest(zero, mean + Z90 * sigma)}


def in_vehicle_seconds(distance_m: Column, speed_mps: Column | float, per_km: float) -> Column:
    return distance_m / speed_mps + distance_m / 1000 * per_km


def add_legs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Quantile-wise sum of two legs, confidence the lower of both. Legs are structs p50, p80, p90, confidence."""
    total = {q: F.col(f"{first}.{q}") + F.col(f"{second}.{q}") for q in ("p50", "p80", "p90")}
    return rows.withColumns({**total, "confidence": F.least(F.col(f"{first}.confidence"), F.col(f"{second}.confidence"))})


def monotone(p50: Column, p80: Column, p90: Column) -> list[Column]:
    """Quantiles at zero or more, none below the one before."""
    a = F.greatest(F.lit(0.0), p50)
    b = F.greatest(a, p80)
    return [a, b, F.greatest(b, p90)]


def enqueue(predictions: DataFrame, grace: float = 600.0) -> DataFrame:
    """Forecast rows: a deterministic id and when they can be resolved."""
    ident = F.sha2(F.concat_ws("|", "corridor_id", F.col("leave_at").cast("string"), "predictor_version"), 256)
    due = F.timestamp_micros(F.floor((seconds_of(F.col("leave_at")) + F.col("p90") + grace) * 1_000_000).cast("long")).cast("timestamp_ntz")
    return predictions.withColumns({"queue_id": ident, "resolve_after": due, "status": F.lit("pending")})


def due_corridors(corridors: DataFrame, now: Column, modes: Sequence[str]) -> DataFrame:
    """Active corridors of the enabled modes whose cadence has passed, most urgent and longest waiting first (``place``)."""
    waited = seconds_of(now) - seconds_of(F.col("last_predicted_at"))
    rows = corridors.where(F.col("is_active") & F.col("mode").isin(*modes) & (F.col("last_predicted_at").isNull() | (waited >= F.col("cadence_s"))))
    return rows.orderBy(F.col("priority"), F.col("last_predicted_at").asc_nulls_first(), "corridor_id")


def popular_pairs(requests: DataFrame, existing: DataFrame, since: Column, least: int = 50) -> DataFrame:
    """Pairs asked for at least ``least`` times successfully since a time, that no corridor serves. Counted before the anti join."""
    counts = requests.where((F.col("queried_at") >= since) & F.col("success")).groupBy("origin", "destination").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return anti_null_safe(counts, existing, ["origin", "destination"])


def shrunk_shift(mean: Column, n: Column, floor: int = 50) -> Column:
    return mean * n / F.greatest(F.lit(floor), n)
