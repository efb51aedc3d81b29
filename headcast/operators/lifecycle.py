"""The life of corridors and forecasts: seeding, promotion, prediction with fall-back, resolution by mode, status, registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.functions.scores import pinball, rounded
from headcast.operators.arrivals import resolve_trips
from headcast.operators.calibration import share
from headcast.operators.joins import seconds_of
from headcast.operators.sinks import insert_if_absent, overwrite


@dataclass(frozen=True)
class ModeRule:
    """How trips of a mode are matched: ``by_line`` (else any line serves), ``later`` (alighting after boarding, not with
    it) and ``apart`` (both ends must differ)."""

    by_line: bool = True
    later: bool = False
    apart: bool = False


MODES = {"l": ModeRule(), "bus": ModeRule(), "metra": ModeRule(later=True, apart=True), "intercampus": ModeRule(by_line=False, later=True, apart=True)}


def due_forecasts(queue: DataFrame, now: Column, limit: int = 200) -> DataFrame:
    """Pending forecasts whose time to be resolved has come, the ``limit`` longest due (a batch's size, not a cut: the rest
    is due in the next one)."""
    return queue.where((F.col("status") == "pending") & (F.col("resolve_after") <= now)).orderBy("resolve_after", "forecast_id").limit(limit)


def resolve_by_mode(requests: DataFrame, observed: DataFrame, horizon: float, modes: dict[str, ModeRule] = MODES) -> DataFrame:
    """``resolve_trips`` by each request's ``mode``; ``observed`` has a mode too. Modes with equal rules go through one plan."""
    parts = None
    for rule in dict.fromkeys(modes.values()):
        names = [m for m, r in modes.items() if r == rule]
        line = F.concat_ws("\u0001", "mode", F.col("line") if rule.by_line else F.lit(""))
        asked = requests.where(F.col("mode").isin(names)).withColumn("line", line).select("request_id", "mode", "line", "board", "alight", "leave_at")
        asked = asked.where("board <> alight") if rule.apart else asked
        seen = observed.where(F.col("mode").isin(names)).withColumn("line", line).select("line", "run", "station", "observed_at").distinct()
        got = resolve_trips(asked, seen, horizon, strict=rule.later).select("request_id", "mode", "run", "nth", "boarded_at", "alighted_at", "wait_s", "ride_s", "total_s")
        parts = got if parts is None else parts.unionByName(got)
    return parts


def settled(queue: DataFrame, outcomes: DataFrame, now: Column, buffer: float = 300.0) -> DataFrame:
    """``queue`` with its status moved on: resolved with an outcome, unresolvable once ``buffer`` seconds past due, else as it was."""
    known = outcomes.select(F.col("forecast_id").alias("__id")).distinct().withColumn("__known", F.lit(True))
    rows = queue.join(known, F.col("forecast_id") == F.col("__id"), "left").drop("__id")
    late = seconds_of(now) >= seconds_of(F.col("resolve_after")) + buffer
    pending, due = F.col("status") == "pending", F.col("resolve_after") <= now
    status = F.when(pending & due & F.col("__known"), "resolved").when(pending & due & late, "unresolvable").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("__known")


def wait_legs(estimates: DataFrame) -> DataFrame:
    """Wait leg of each estimate (seconds from now): its time and the upper ends of its intervals, in order; withheld ones give none."""
    zero = F.lit(0.0)
    p50 = F.greatest(zero, F.col("arrival_s"))
    p80 = F.greatest(p50, F.coalesce("high80", p50))
    return estimates.where(~F.col("abstain") & F.col("arrival_s").isNotNull()).withColumns({"p50": p50, "p80": p80, "p90": F.greatest(p80, F.coalesce("high90", p80)), "mean": p50, "confidence": F.col("reliability")})


def first_prediction(corridors: DataFrame, predictions: DataFrame, active: DataFrame, kernel: str = "kernel") -> DataFrame:
    """One prediction per corridor: its active version's, else the kernel's; ``fell_back`` tells which. Corridors for which
    neither predicts aren't returned.

    ``predictions``: corridor_id, predictor_version and any values, one row per both. ``active``: corridor_id, version.
    """
    values = [c for c in predictions.columns if c not in ("corridor_id", "predictor_version")]
    chosen = corridors.select("corridor_id").join(active.select("corridor_id", "version"), "corridor_id", "left").withColumn("version", F.coalesce("version", F.lit(kernel)))
    own = F.max(F.when(F.col("predictor_version") == F.col("version"), F.struct("predictor_version", *values)))
    other = F.max(F.when(F.col("predictor_version") == kernel, F.struct("predictor_version", *values)))
    by = chosen.join(predictions, "corridor_id").groupBy("corridor_id").agg(own.alias("own"), other.alias("other"))
    rows = by.where("own is not null or other is not null").select("corridor_id", F.coalesce("own", "other").alias("p"), F.col("own").isNull().alias("fell_back"))
    return rows.select("corridor_id", "p.*", "fell_back")


def seeded(existing: DataFrame, specs: DataFrame, now: Column) -> DataFrame:
    """Corridors after a (re)seed: a spec replaces its corridor's values but keeps when it was last predicted."""
    kept = existing.select("corridor_id", F.col("last_predicted_at").alias("__last"))
    fresh = specs.join(kept, "corridor_id", "left").withColumns({"last_predicted_at": F.col("__last"), "seeded_at": now}).drop("__last")
    return existing.join(specs.select("corridor_id"), "corridor_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def mark_predicted(corridors: DataFrame, predicted: DataFrame, at: Column) -> DataFrame:
    """``corridors`` with ``last_predicted_at`` moved to ``at`` for those tried, whether they got a prediction or not."""
    tried = predicted.select("corridor_id").distinct().withColumn("__tried", F.lit(True))
    return corridors.join(tried, "corridor_id", "left").withColumn("last_predicted_at", F.when(F.col("__tried"), at).otherwise(F.col("last_predicted_at"))).drop("__tried")


def promoted(popular: DataFrame, catalogue: DataFrame, headways: dict[str, float], existing: DataFrame, now: Column) -> DataFrame:
    """New corridors out of popular pairs (mode, line, origin, destination, n): both ends must be in the ``catalogue``
    (mode, stop, name, lat, lon); ids that exist already are left alone."""
    end = lambda side: catalogue.select(F.col("mode"), F.col("stop").alias(side), F.struct("name", "lat", "lon").alias(f"{side}_at"))
    rows = popular.join(end("origin"), ["mode", "origin"]).join(end("destination"), ["mode", "destination"])
    headway = F.coalesce(*[F.when(F.col("mode") == m, F.lit(h)) for m, h in headways.items()])
    ident = F.lower(F.concat_ws("-", F.lit("auto"), "mode", "line", F.col("origin").cast("string"), F.col("destination").cast("string")))
    made = rows.select(
        ident.alias("corridor_id"), "mode", "line", F.col("origin_at.name").alias("origin_label"), F.col("destination_at.name").alias("destination_label"), headway.alias("headway_s"), F.lit("auto_upgraded").alias("source"),
        F.col("n").alias("promoted_from"), now.alias("seeded_at"),
    )
    return insert_if_absent(existing.select("corridor_id"), made, ["corridor_id"], "promoted_from")


def registered(registry: DataFrame, fitted: DataFrame, version: str, now: Column) -> DataFrame:
    """The model registry after a fit: one row per (version, line, quantile) with the coefficients, newest wins."""
    rows = fitted.select(F.lit(version).alias("version"), "line", "q", F.to_json(F.struct(*[c for c in fitted.columns if c not in ("line", "q")])).alias("coefficients"), now.alias("fitted_at"))
    return overwrite(registry, rows, ["version", "line", "q"], "fitted_at")


def window_evaluation(scored: DataFrame, since: Column, until: Column) -> DataFrame:
    """Wait-leg scores of each predictor over outcomes of a time window: rows, losses, coverage, mean miss."""
    rows = scored.where(F.col("resolved_at").between(since, until) & F.col("actual_wait").isNotNull())
    loss = lambda q: rounded(F.avg(pinball(q, F.col("actual_wait"), F.col(f"wait_p{round(100 * q)}")))).alias(f"pinball_{round(100 * q)}")
    return rows.groupBy("predictor_version").agg(
        F.count("*").alias("n"), loss(0.5), loss(0.8), loss(0.9), rounded(share(F.col("actual_wait") <= F.col("wait_p80"))).alias("coverage_80"),
        rounded(F.avg(F.abs(F.col("actual_wait") - F.col("wait_p50")))).alias("mae"),
    )


def newest_rows(rows: DataFrame, keys: Sequence[str], at: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows of each key, newest first."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[c for c in rows.columns if c not in (*keys, at)])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def purged(rows: DataFrame, **values) -> DataFrame:
    """``rows`` without those that have all the given values; unknown values stay."""
    same = F.lit(True)
    for name, value in values.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return rows.where(~same)
