"""Queries of the learner: frames per leg, splits by rows, quantile trees, and what they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions.scores import rounded
from headcast.operators import training, trees
from headcast.plans.calibration import scored
from headcast.sources.proxies import sql

FEATURES = ("horizon_s", "hour_of_day", "weekday", "haversine_m")
LABELS = {"wait": "residual_wait_s", "in_vehicle": "residual_in_vehicle_s"}
VERSIONS = ("pv0", "pv1")


def queue(s: SparkSession, d: str) -> DataFrame:
    """Resolved forecasts with what was known when they were made, as JSON, and both legs' truths."""
    key = F.col("forecast_id")
    features = F.to_json(F.struct(F.when(key % 3 != 0, 40 + key % 900).alias("seconds_until_next_arrival"), (500 + key % 60 * 100).alias("haversine_meters"), F.when(key % 8 != 0, key % 24).alias("hour_of_day")))
    return scored(s, d).select(
        "forecast_id", "mode", "line", "direction_code", "predictor_version", "status", "leave_at", (F.col("leave_at") - F.make_dt_interval(secs=(60 + key % 400).cast("decimal(18,6)"))).alias("snapshot_polled_at"),
        F.when(key % 31 == 0, "{not json").otherwise(features).alias("feature_json"), (0.25 * F.col("p50")).alias("kernel_wait_p50"), (0.7 * F.col("p50")).alias("kernel_in_vehicle_mean"),
        F.when(key % 29 != 0, 0.25 * F.col("actual")).alias("actual_wait"), F.when(key % 9 != 0, 0.7 * F.col("actual")).alias("actual_in_vehicle"), "truth_confidence",
    )


def frame(s: SparkSession, d: str) -> DataFrame:
    return training.leg_frame(queue(s, d), VERSIONS, min_confidence=0.25)


def f33_leg_frame(s: SparkSession, d: str) -> DataFrame:
    numbers = ("haversine_m", "horizon_s", "residual_wait_s", "residual_in_vehicle_s", "truth_confidence")
    return frame(s, d).select("forecast_id", "line", "direction_code", "hour_of_day", "weekday", *[rounded(F.coalesce(c, F.lit(-1e9))).alias(c) for c in numbers])


def f34_row_split(s: SparkSession, d: str) -> DataFrame:
    return training.row_split(frame(s, d), "leave_at", "forecast_id", 0.15, 20).select("forecast_id", "is_validation")


def legs(s: SparkSession, d: str) -> DataFrame:
    split = training.row_split(frame(s, d), "leave_at", "forecast_id", 0.15, 20)
    return trees.long_legs(split.select(F.col("forecast_id").alias("id"), "is_validation", "line", *FEATURES, *LABELS.values(), "truth_confidence"), FEATURES, LABELS, F.col("truth_confidence"))


def f35_quantile_trees(s: SparkSession, d: str) -> DataFrame:
    """Trees per (leg, line, quantile), as nodes, with their losses on the last rows in time."""
    rows = legs(s, d)
    model = trees.fit_trees(rows.where("not is_validation"), len(FEATURES))
    losses = trees.validated(rows.where("is_validation"), model)
    return model.join(losses, ["leg", "line", "q"], "left").select("leg", "line", "q", "node", "feature", *[rounded(F.col(c), 4).alias(c) for c in ("threshold", "gain", "value", "pinball", "crps")], "n", "n_val")


#: A fixed tree of depth 3: (feature, threshold) of its inner nodes.
FIXED = {1: (0, 400.0), 2: (1, 11.0), 3: (3, 3000.0), 4: (2, 0.0), 6: (0, 700.0), 7: (1, 5.0)}


def fixed_model(s: SparkSession) -> DataFrame:
    """``FIXED`` for every leg and line, with leaves that follow from their number and quantile."""
    leaves = sorted({c for n in FIXED for c in (2 * n, 2 * n + 1)} - set(FIXED))
    lines = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    cells = [(leg, line, q) for leg in LABELS for line in lines for q in (0.5, 0.8, 0.9)]
    inner = [(*c, n, f, t, None) for c in cells for n, (f, t) in FIXED.items()]
    ends = [(leg, line, q, n, None, None, 100.0 * q + 7 * n - 10 * int(line[0]) - (60 if leg == "wait" else 0)) for leg, line, q in cells for n in leaves]
    return s.createDataFrame(inner + ends, "leg string, line string, q double, node int, feature int, threshold double, value double")


def f36_tree_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of both legs by a fixed model, with conformal offsets for some lines, in order twice."""
    known = queue(s, d).select(F.col("forecast_id").alias("id"), "kernel_wait_p50", "kernel_in_vehicle_mean")
    rows = legs(s, d).join(known, "id")
    base = F.when(F.col("leg") == "wait", F.col("kernel_wait_p50")).otherwise(F.col("kernel_in_vehicle_mean"))
    offsets = s.createDataFrame([("wait", "1-URGENT", 0.8, -500.0), ("wait", "2-HIGH", 0.9, 25.0), ("in_vehicle", "1-URGENT", 0.9, 40.0)], "leg string, line string, q double, offset_s double")
    got = trees.leg_quantiles(rows, fixed_model(s), base, offsets)
    return got.select(F.col("id").alias("forecast_id"), "leg", "line", *[rounded(F.col(c)).alias(c) for c in ("p50", "p80", "p90")])


QUERIES = {f.__name__: f for f in (f33_leg_frame, f34_row_split, f35_quantile_trees, f36_tree_quantiles)}

QUEUE = """SELECT forecast_id, line, direction_code, leave_at, forecast_id AS key, forecast_id % 31 <> 0 AS json, 0.25::DOUBLE * p50 AS kernel_wait_p50, 0.7::DOUBLE * p50 AS kernel_in_vehicle_mean,
  CASE WHEN forecast_id % 29 <> 0 THEN 0.25::DOUBLE * actual END AS actual_wait, CASE WHEN forecast_id % 9 <> 0 THEN 0.7::DOUBLE * actual END AS actual_in_vehicle, truth_confidence
  FROM scored WHERE status = 'resolved' AND mode = 'l' AND predictor_version IN ('pv0', 'pv1') AND coalesce(truth_confidence, 0) >= 0.25"""
LEGS = """SELECT *, actual_wait - kernel_wait_p50 AS residual_wait_s, actual_in_vehicle - kernel_in_vehicle_mean AS residual_in_vehicle_s FROM (SELECT *, CASE WHEN json AND key % 3 <> 0 THEN CAST(40 + key % 900 AS DOUBLE) ELSE CAST(60 + key % 400 AS DOUBLE) END AS horizon_s,
  CAST(CASE WHEN json AND key % 8 <> 0 THEN key % 24 ELSE hour(leave_at) END AS INTEGER) AS hour_of_day, isodow(leave_at) <= 5 AS weekday, CASE WHEN json THEN CAST(500 + key % 60 * 100 AS DOUBLE) ELSE 0.0::DOUBLE END AS haversine_m FROM queue_) WHERE actual_wait IS NOT NULL AND horizon_s >= 90"""
SPLIT = """SELECT *, CASE WHEN n <= 20 OR n - greatest(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), 20) < 20 THEN false ELSE rank > n - greatest(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), 20) END AS is_validation
  FROM (SELECT *, row_number() OVER (ORDER BY leave_at, forecast_id) AS rank, count(*) OVER () AS n FROM legs)"""


def _walk_sql(node: int) -> str:
    if node not in FIXED:
        return str(node)
    feature, threshold = FIXED[node]
    return f"CASE WHEN CAST({FEATURES[feature]} AS DOUBLE) <= {threshold} THEN {_walk_sql(2 * node)} ELSE {_walk_sql(2 * node + 1)} END"


def _value_sql(q: float) -> str:
    return f"(base + {100.0 * q} + 7 * node - 10 * CAST(line[1] AS INTEGER) - CASE leg WHEN 'wait' THEN 60 ELSE 0 END)::DOUBLE"


ORACLE = {
    "f33_leg_frame": sql(
        """SELECT forecast_id, line, direction_code, hour_of_day, weekday, round(haversine_m, 6) AS haversine_m, round(horizon_s, 6) AS horizon_s, round(coalesce(residual_wait_s, -1e9), 6) AS residual_wait_s,
        round(coalesce(residual_in_vehicle_s, -1e9), 6) AS residual_in_vehicle_s, round(truth_confidence, 6) AS truth_confidence FROM legs""", "scored", queue_=QUEUE, legs=LEGS),
    "f34_row_split": sql("SELECT forecast_id, is_validation FROM split", "scored", queue_=QUEUE, legs=LEGS, split=SPLIT),
    "f36_tree_quantiles": sql(
        f"""SELECT forecast_id, leg, line, round(p50, 6) AS p50, round(greatest(p50, p80), 6) AS p80, round(greatest(p50, p80, p90), 6) AS p90
        FROM (SELECT forecast_id, leg, line, a AS p50, greatest(a, b) + CASE WHEN leg = 'wait' AND line = '1-URGENT' THEN -500 ELSE 0 END AS p80,
          greatest(a, b, c) + CASE WHEN leg = 'wait' AND line = '2-HIGH' THEN 25 WHEN leg = 'in_vehicle' AND line = '1-URGENT' THEN 40 ELSE 0 END AS p90
          FROM (SELECT *, greatest(0, {_value_sql(0.5)}) AS a, {_value_sql(0.8)} AS b, {_value_sql(0.9)} AS c FROM (SELECT *, {_walk_sql(1)} AS node FROM each_)))""", "scored", queue_=QUEUE, legs=LEGS,
        each_="""SELECT *, 'wait' AS leg, kernel_wait_p50 AS base FROM legs WHERE residual_wait_s IS NOT NULL UNION ALL SELECT *, 'in_vehicle', kernel_in_vehicle_mean FROM legs WHERE residual_in_vehicle_s IS NOT NULL"""),
}
