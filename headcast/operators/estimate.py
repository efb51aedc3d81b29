"""Arrival estimates from evidence: rules add to a score and give reasons, then times are blended and intervals set.

Lookups are joins done before; here every row already carries its evidence as columns, and everything is one
projection. ``Rule`` order is the order of additions, so scores are the same to the last digit however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``when`` holds: ``delta`` is added and ``reason`` given; ``abstain`` withholds the estimate. Unknown is no."""

    when: str
    delta: float
    reason: str | None = None
    abstain: bool = False


#: Evidence rules of bus arrivals, from a start of 0.52.
BUS_START = 0.52
BUS_RULES = (
    Rule("prediction_age_s <= 60", 0.06, "PREDICTION_FRESH"),
    Rule("prediction_age_s > 120", -0.18, "PREDICTION_STALE"),
    Rule("dyn in (1, 12, 18)", -0.85, "DYN_CANCELED", True),
    Rule("dyn = 4", -0.85, "DYN_EXPRESSED", True),
    Rule("dyn in (16, 17)", -0.85, "DYN_INVALIDATED", True),
    Rule("dyn = 2", -0.18, "DYN_REASSIGNED"),
    Rule("dyn in (9, 10)", -0.22, "DYN_PARTIAL_TRIP"),
    Rule("dyn in (3, 14, 15)", -0.10, "DYN_DELAYED_OR_SHIFTED"),
    Rule("dyn in (6, 8, 13, 19)", -0.06),
    Rule("delayed", -0.04, "DLY_TRUE"),
    Rule("flagstop = 2", -0.75, "FLAGSTOP_ONLY_DISCHARGE", True),
    Rule("detour_active", -0.10, "DETOUR_ACTIVE"),
    Rule("stop_removed", -0.85, "STOP_REMOVED_BY_DETOUR", True),
    Rule("stop_added", -0.03, "STOP_ADDED_BY_DETOUR"),
    Rule("not vehicle_found", -0.30, "VEHICLE_NOT_FOUND"),
    Rule("vehicle_found", 0.06, "VEHICLE_FOUND"),
    Rule("vehicle_found and vehicle_age_s <= 60", 0.12, "VEHICLE_POSITION_FRESH"),
    Rule("vehicle_found and (vehicle_age_s is null or vehicle_age_s > 120)", -0.30, "VEHICLE_POSITION_STALE"),
    Rule("vehicle_found and same_route", 0.04, "ROUTE_DIRECTION_MATCH"),
    Rule("vehicle_found and not same_route", -0.18, "ROUTE_DIRECTION_MISMATCH"),
    Rule("vehicle_found and stop_pdist is not null", 0.08, "PATTERN_MATCH"),
    Rule("vehicle_found and stop_pdist is null", -0.14, "PATTERN_MISMATCH"),
    Rule("vehicle_found and map_quality in ('HIGH', 'MEDIUM')", 0.04, "GPS_ON_EXPECTED_PATTERN"),
    Rule("vehicle_found and map_quality in ('LOW', 'UNUSABLE')", -0.12, "GPS_OFF_EXPECTED_PATTERN"),
    Rule("vehicle_found and abs(projected - pdist) > 2000", -0.14, "GPS_PDIST_INCONSISTENT"),
    Rule("vehicle_found and distance_stop_m <= 60", 0.0, "GPS_NEAR_STOP"),
    Rule("vehicle_found and pdist_trend = 'monotone'", 0.05, "PDIST_INCREASING"),
    Rule("vehicle_found and pdist_trend = 'stalled'", -0.06, "PDIST_STALLED"),
    Rule("vehicle_found and stop_pdist - pdist < -50 and typ <> 'D'", -0.55, "PDIST_CROSSED_STOP", True),
    Rule("vehicle_found and stop_pdist - pdist < -50 and typ = 'D'", -0.25, "PDIST_CROSSED_STOP"),
    Rule("dstp_trend = 'monotone'", 0.05, "DSTP_DECREASING"),
    Rule("dstp_trend = 'stalled'", -0.08, "DSTP_STALLED"),
    Rule("dstp_trend = 'nonmonotone'", -0.10, "DSTP_INCREASING"),
    Rule("volatility_s <= 45", 0.03, "PREDICTION_STABLE"),
    Rule("volatility_s >= 120", -0.15, "PREDICTION_VOLATILE"),
    Rule("eta_s <= 90 and distance_stop_m > 350 and vehicle_age_s <= 60", -0.18, "DUE_BUT_VEHICLE_NOT_NEAR_STOP"),
)
BUS_EVIDENCE = {
    "prediction_age_s": "double", "dyn": "int", "delayed": "boolean", "flagstop": "int", "detour_active": "boolean", "stop_removed": "boolean", "stop_added": "boolean", "vehicle_found": "boolean", "vehicle_age_s": "double",
    "same_route": "boolean", "stop_pdist": "double", "pdist": "double", "projected": "double", "map_quality": "string", "distance_stop_m": "double", "pdist_trend": "string", "dstp_trend": "string", "volatility_s": "double", "eta_s": "double", "typ": "string",
    "speed_ftps": "double", "dstp_ft": "double",
}
#: Evidence rules of train arrivals, from a start of 0.55.
TRAIN_START = 0.55
TRAIN_RULES = (
    Rule("prediction_age_s <= 60", 0.10, "PREDICTION_FRESH"),
    Rule("prediction_age_s > 180", -0.20, "PREDICTION_STALE"),
    Rule("fault", -0.60, "IS_FAULT_FLAG", True),
    Rule("delayed", -0.08, "IS_DELAYED_FLAG"),
    Rule("approaching", 0.10, "IS_APPROACHING_TRUE"),
    Rule("scheduled", -0.15, "IS_SCHEDULED_FALLBACK"),
    Rule("not position_found", -0.18, "POSITION_NOT_FOUND"),
    Rule("position_found and position_age_s <= 90", 0.08, "POSITION_FOUND"),
    Rule("position_found and position_age_s > 240", -0.15, "POSITION_STALE"),
    Rule("position_found and next_station = station", 0.10, "NEXT_STATION_MATCH"),
    Rule("position_found and next_station <> station and downstream", 0.03, "NEXT_STATION_MATCH"),
    Rule("position_found and next_station <> station and not downstream", -0.55, "NEXT_STATION_ADVANCED", True),
    Rule("position_found and next_station <> station and downstream is null", 0.0, "FOLLOW_MISSING"),
    Rule("position_found and position_fault", -0.40, "IS_FAULT_FLAG", True),
    Rule("follow_gap_s is null", 0.0, "FOLLOW_MISSING"),
    Rule("follow_gap_s <= 30", 0.10, "FOLLOW_TRAJECTORY_CONSISTENT"),
    Rule("follow_gap_s > 90", -0.12, "FOLLOW_TRAJECTORY_DIVERGENT"),
    Rule("gtfsrt_gap_s is null", 0.0, "GTFSRT_MISSING"),
    Rule("gtfsrt_gap_s <= 45", 0.10, "GTFSRT_AGREE"),
    Rule("gtfsrt_gap_s > 120", -0.10, "GTFSRT_DISAGREE"),
    Rule("approaching and follow_gap_s <= 30 and gtfsrt_gap_s <= 45", 0.08, "THREE_WAY_AGREE"),
    Rule("int(coalesce(approaching, false)) + int(coalesce(follow_gap_s <= 30, false)) + int(coalesce(gtfsrt_gap_s <= 45, false)) = 2", 0.04, "TWO_WAY_AGREE"),
    Rule("volatility_s <= 30", 0.04, "PREDICTION_STABLE"),
    Rule("volatility_s >= 90", -0.12, "PREDICTION_VOLATILE"),
)


def judge(evidence: DataFrame, rules: Sequence[Rule], start: float) -> DataFrame:
    """Adds ``score`` (before clamping), ``abstain`` and ``reasons`` (sorted, distinct)."""
    score, reasons, abstain = F.lit(start), [], F.lit(False)
    for rule in rules:
        holds = F.coalesce(F.expr(rule.when), F.lit(False))
        if rule.delta:
            score = score + F.when(holds, rule.delta).otherwise(0.0)
        if rule.reason:
            reasons.append(F.when(holds, rule.reason))
        if rule.abstain:
            abstain = abstain | holds
    return evidence.withColumns({"score": score, "abstain": abstain, "reasons": F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))})


def display_state(score: Column, abstain: Column) -> Column:
    return F.when(abstain, "do_not_display").when(score >= 0.82, "high").when(score >= 0.62, "medium").when(score >= 0.40, "low").otherwise("unreliable")


def intervals(at: Column, half: Column) -> dict[str, Column]:
    return {f"{side}{level}": at + sign * factor * half for level, factor in ((80, 1.0), (90, 1.55), (95, 2.05)) for side, sign in (("low", -1), ("high", 1))}


def bus_estimates(evidence: DataFrame) -> DataFrame:
    """Bus estimates in seconds from now: the feed's own time blended with the geometry's by how far they agree."""
    judged = judge(evidence, BUS_RULES, BUS_START)
    remaining = F.when(F.col("vehicle_found"), F.col("stop_pdist") - F.col("pdist"))
    geometry = F.when(remaining >= 0, F.when(F.col("speed_ftps").isNotNull(), remaining / F.greatest("speed_ftps", F.lit(0.1))).otherwise(F.col("dstp_ft") / 18.0))
    rows = judged.withColumn("geometry_s", geometry).withColumn("gap_s", F.abs(F.col("eta_s") - F.col("geometry_s")))
    both, gap, eta, geo = F.col("gap_s").isNotNull(), F.col("gap_s"), F.col("eta_s"), F.col("geometry_s")
    weight = F.when((eta <= 90) & (geo > 180), 0.25).when(F.col("prediction_age_s") > 60, 0.35).when(F.col("speed_ftps").isNull(), 0.75).otherwise(0.55)
    blend = F.when(gap <= 75, 0.68 * eta + 0.32 * geo).when(both, weight * eta + (1 - weight) * geo).otherwise(F.coalesce(eta, geo))
    none = F.col("abstain") | (eta.isNull() & geo.isNull())
    change = (
        F.when(F.col("abstain"), 0.0).when(gap <= 75, 0.08).when(both, -F.least(F.lit(0.28), gap / 600.0)).when(eta.isNotNull(), F.when(F.col("vehicle_found"), -0.02).otherwise(-0.06)).when(geo.isNotNull(), -0.10).otherwise(-0.35)
    )
    more = F.array_compact(F.array(F.when(~F.col("abstain") & (gap <= 75), "FEED_GEOMETRY_AGREE"), F.when(~F.col("abstain") & (gap > 75), "FEED_GEOMETRY_DISAGREE"), F.when(~F.col("abstain") & none, "ARRIVAL_ESTIMATE_ABSTAINED")))
    scored = rows.withColumns({"reliability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + change)), "arrival_s": F.when(~none, F.greatest(F.lit(0.0), blend)), "reasons": F.array_sort(F.array_union("reasons", more)), "abstain": none})
    # unknown evidence widens nothing: greatest and least would pass over a null
    plus = lambda c, f, top=None: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c) - 30) * f if top is None else F.least(F.lit(top), f * F.col(c))).otherwise(0.0)
    half = (28.0 + 0.12 * F.col("arrival_s") + plus("vehicle_age_s", 0.35) + plus("prediction_age_s", 0.25) + plus("gap_s", 0.35, 180.0) + plus("volatility_s", 0.45, 120.0) + F.when(F.col("detour_active"), 60.0).otherwise(0.0)) * (1 + F.greatest(F.lit(0.0), 0.75 - F.col("reliability")))
    ready = scored.withColumn("half_s", F.greatest(F.lit(25.0), F.least(F.lit(600.0), half)))
    return ready.withColumns({**intervals(F.col("arrival_s"), F.col("half_s")), "display": display_state(F.col("reliability"), F.col("abstain"))})


def train_estimates(evidence: DataFrame) -> DataFrame:
    """Train estimates in seconds from now; the run's own follow feed pulls the arrival feed by three tenths."""
    judged = judge(evidence, TRAIN_RULES, TRAIN_START)
    at = F.when(~F.col("abstain"), F.when(F.col("follow_s").isNotNull(), 0.7 * F.col("eta_s") + 0.3 * F.col("follow_s")).otherwise(F.col("eta_s")))
    rows = judged.withColumns({"reliability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), "arrival_s": at})
    late = lambda c, f: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c) - 30) * f).otherwise(0.0)
    half = (25.0 + 0.10 * F.greatest(F.lit(0.0), F.col("arrival_s")) + late("prediction_age_s", 0.25) + late("position_age_s", 0.20)) * (1 + F.greatest(F.lit(0.0), 0.75 - F.col("reliability")))
    ready = rows.withColumn("half_s", F.greatest(F.lit(20.0), F.least(F.lit(480.0), half)))
    return ready.withColumns({**intervals(F.col("arrival_s"), F.col("half_s")), "display": display_state(F.col("reliability"), F.col("abstain"))})


def trend(values: Column, decreasing: bool, tolerance: float = 1.0) -> Column:
    """Name of a short series' course: monotone, stalled, nonmonotone, or unknown below three values."""
    n = F.size(values)
    steps = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: (a - b) if decreasing else (b - a))
    good, bad = F.size(F.filter(steps, lambda s: s > tolerance)), F.size(F.filter(steps, lambda s: s < -tolerance))
    return F.when(values.isNull() | (n < 3), "unknown").when(bad > good, "nonmonotone").when(good == 0, "stalled").otherwise("monotone")
