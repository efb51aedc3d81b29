"""Training frames, readiness, splits and a distributed residual-quantile model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.checkpoints import cut


def training_frame(scored: DataFrame, horizon: Column, min_confidence: float = 0.5, min_horizon: float = 90.0) -> DataFrame:
    """Features and residual labels of resolved, trusted rows whose ``horizon`` (seconds) is unknown or long enough."""
    ok = (F.col("status") == "resolved") & F.col("actual").isNotNull() & (F.coalesce("truth_confidence", F.lit(0.0)) >= min_confidence)
    rows = scored.where(ok & (horizon.isNull() | (horizon >= min_horizon)))
    return rows.select("forecast_id", "line", "direction_code", "leave_at", F.hour("leave_at").alias("hod"), F.dayofweek("leave_at").between(2, 6).alias("weekday"), "p50", "p80", horizon.alias("horizon_s"), (F.col("actual") - F.col("p50")).alias("residual"))


def leg_frame(queue: DataFrame, versions: Sequence[str], mode: str = "l", min_confidence: float = 0.5, min_horizon: float = 90.0) -> DataFrame:
    """What the learner sees of resolved forecasts: features as they were when predicting, and a residual per leg.

    ``queue``: forecast_id, mode, line, direction_code, predictor_version, status, leave_at, snapshot_polled_at, feature_json, the kernel's
    kernel_wait_p50 and kernel_in_vehicle_mean, actual_wait, actual_in_vehicle and truth_confidence. The horizon is the snapshot's time to
    the next arrival, else the time from the snapshot to leaving; rows known to be nearer than ``min_horizon`` are left out, as
    their residuals vanish by construction. Text that isn't JSON counts as no features; a leg without a truth has no residual.
    """
    ok = (F.col("status") == "resolved") & (F.col("mode") == mode) & F.col("predictor_version").isin(*versions) & F.col("actual_wait").isNotNull()
    rows = queue.where(ok & (F.coalesce("truth_confidence", F.lit(0.0)) >= min_confidence))
    of = lambda name: F.expr(f"try_cast(get_json_object(feature_json, '$.{name}') as double)")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    text = lambda name: F.coalesce(F.nullif(F.get_json_object("feature_json", f"$.{name}"), F.lit("")), F.col(name), F.lit(""))
    apart = (F.unix_micros(F.col("leave_at").cast("timestamp")) - F.unix_micros(F.col("snapshot_polled_at").cast("timestamp"))) / 1e6
    horizon = F.coalesce(finite(of("seconds_until_next_arrival")), apart)
    hour = F.coalesce(of("hour_of_day").cast("int"), F.hour("leave_at"), F.lit(0))
    zero = F.lit(0.0)
    made = rows.select(
        "forecast_id", "leave_at", text("line").alias("line"), text("direction_code").alias("direction_code"), hour.alias("hour_of_day"), F.coalesce(F.weekday("leave_at") < 5, F.lit(False)).alias("weekday"),
        F.coalesce(finite(of("haversine_meters")), zero).alias("haversine_m"), horizon.alias("horizon_s"), (F.col("actual_wait") - F.coalesce("kernel_wait_p50", zero)).alias("residual_wait_s"),
        (F.col("actual_in_vehicle") - F.coalesce("kernel_in_vehicle_mean", zero)).alias("residual_in_vehicle_s"), F.coalesce("truth_confidence", F.lit(0.5)).alias("truth_confidence"),
    )
    return made.where(F.col("horizon_s").isNull() | (F.col("horizon_s") >= min_horizon))


def row_split(frame: DataFrame, at: str, id_col: str, share: float = 0.1, min_rows: int = 100) -> DataFrame:
    """``is_validation``: the last ``share`` of rows by time and id, ``min_rows`` at least; none if too few were left to train on.

    The row of that rank is found without a global sort: rows are counted by day, then by second within the day that holds
    it, and only the rows of that one second are put in order. A few numbers reach the driver. Rows without a time come first.
    """
    n = frame.count()
    size = max(int(n * share), min_rows) if n > min_rows else 0
    if not size or n - size < min_rows:
        return frame.withColumn("is_validation", F.lit(False))
    timed = frame.where(F.col(at).isNotNull()).select(F.col(at).alias("at"), F.col(id_col).alias("id"))
    rank = timed.count() - size
    if rank < 0:
        # even rows without a time are needed: all that have one are validation
        return frame.withColumn("is_validation", F.col(at).isNotNull())
    for cell in (F.to_date("at"), F.unix_seconds(F.col("at").cast("timestamp"))):
        cells = timed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("cell")) - F.col("n")
        found = cells.withColumn("before", before).where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).first()
        timed, rank = timed.where(cell == F.lit(found["cell"])), rank - found["before"]
    last = timed.orderBy("at", "id").limit(rank + 1).agg(F.max(F.struct("at", "id")).alias("cut")).first()["cut"]
    later = (F.col(at) > F.lit(last["at"])) | ((F.col(at) == F.lit(last["at"])) & (F.col(id_col) >= F.lit(last["id"])))
    return frame.withColumn("is_validation", F.coalesce(later, F.lit(False)))


def readiness(scored: DataFrame, strong: int = 100) -> DataFrame:
    """Rows to train on, buckets they fall into and how many of these are strong, as one row."""
    by = scored.where(F.col("status") == "resolved").groupBy("line", "direction_code").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_buckets"), F.count_if(F.col("n") >= strong).alias("n_strong"))


def time_split(frame: DataFrame, at: str = "leave_at", share: float = 0.2) -> DataFrame:
    """``is_validation``: rows from the day on that begins the last ``share`` of rows.

    Days are counted and summed up first, so no global sort of rows is needed; the split falls between days.
    """
    days = frame.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n").alias("total"))
    upto = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(total))
    first = upto.where(F.col("before") >= (1 - share) * F.col("total")).agg(F.min("day").alias("first_day"))
    return frame.join(F.broadcast(first)).withColumn("is_validation", F.coalesce(F.to_date(at) >= F.col("first_day"), F.lit(False))).drop("first_day")


#: Lines of a model that are broadcast; beyond, rows and models are joined by exchange.
FEW_LINES = 100_000


def _side(lines: DataFrame) -> DataFrame:
    return F.broadcast(lines) if lines.count() <= FEW_LINES else lines


def fit_residual_quantiles(frame: DataFrame, features: Sequence[str], quantiles: Sequence[float] = (0.5, 0.8, 0.9), rounds: int = 20, rate: float = 1.0) -> DataFrame:
    """Linear quantile models of the residual per line: ``line``, ``q``, ``b0`` (intercept), ``b1``.. per feature.

    Subgradient steps of the pinball loss on standardised features. All lines and quantiles share one pass per round:
    rows are weighed up into one gradient per (line, q), which is all that leaves a task.
    """
    stats = frame.groupBy("line").agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}") for c in features], F.avg("residual").alias("m"), F.coalesce(F.stddev_pop("residual"), F.lit(1.0)).alias("s"))
    stats = cut(stats)
    rows = frame.join(_side(stats), "line").select("line", ((F.col("residual") - F.col("m")) / F.greatest("s", F.lit(1e-9))).alias("y"), *[((F.col(c) - F.col(f"m_{c}")) / F.greatest(f"s_{c}", F.lit(1e-9))).alias(f"x{i + 1}") for i, c in enumerate(features)])
    rows = cut(rows.withColumn("x0", F.lit(1.0)))
    p = len(features) + 1
    model = cut(stats.select("line", F.explode(F.array(*map(F.lit, quantiles))).alias("q"), *[F.lit(0.0).alias(f"b{i}") for i in range(p)]))
    for k in range(rounds):
        guess = sum((F.col(f"b{i}") * F.col(f"x{i}") for i in range(1, p)), F.col("b0"))
        push = F.when(F.col("y") > guess, F.col("q")).otherwise(F.col("q") - 1)
        step = rows.join(_side(model), "line").groupBy("line", "q").agg(*[F.avg(push * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)])
        model = cut(model.join(step, ["line", "q"]).select("line", "q", *[(F.col(f"b{i}") + rate / (k + 1) ** 0.5 * F.col(f"g{i}")).alias(f"b{i}") for i in range(p)]))
    raw = model.join(_side(stats), "line")
    slope = {f"b{i + 1}": F.col(f"b{i + 1}") * F.col("s") / F.greatest(f"s_{c}", F.lit(1e-9)) for i, c in enumerate(features)}
    base = F.col("m") + F.col("s") * F.col("b0")
    for i, c in enumerate(features):
        base = base - slope[f"b{i + 1}"] * F.col(f"m_{c}")
    return raw.select("line", "q", base.alias("b0"), *[v.alias(k) for k, v in slope.items()])


def apply_residual_quantiles(rows: DataFrame, model: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``residual_q``: a map from quantile to the modelled residual. The model has a few rows per line."""
    wide = model.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("q", F.struct(*[f"b{i}" for i in range(len(features) + 1)])))).alias("__m"))
    value = lambda v: sum((v[f"b{i + 1}"] * F.col(c) for i, c in enumerate(features)), v["b0"])
    return rows.join(_side(wide), "line", "left").withColumn("residual_q", F.transform_values("__m", lambda k, v: value(v))).drop("__m")
