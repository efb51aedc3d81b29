"""How well forecasts did: coverage, reliability, PIT, scoreboards. All are one pass of joins and grouped aggregates.

``scored`` is forecasts joined with outcomes (``score_join``): forecast_id, mode, line, direction_code, leave_at,
predictor_version, p50, p80, p90, status, corridor_id, failure_prob, actual, truth_confidence, hits and residuals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.functions.scores import NORMAL, Z80, crps, interval_score, libm_log, lognormal_mu, lognormal_quantile, lognormal_sigma, pinball, rounded

QUANTILES = tuple(k / 10 for k in range(1, 10))


def share(condition: Column) -> Column:
    """Mean of a condition, unknown counting as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def score_join(forecasts: DataFrame, outcomes: DataFrame, how: str = "inner") -> DataFrame:
    """Forecasts with what happened: hits within the p80 and p90 windows, residuals."""
    a = F.col("actual")
    return forecasts.join(outcomes, "forecast_id", how).withColumns(
        {"in_p80": a <= F.col("p80"), "in_p90": a <= F.col("p90"), "p50_residual": a - F.col("p50"), "p80_residual": a - F.col("p80")}
    )


def when_of(leave_at: str = "leave_at") -> tuple[Column, Column]:
    """Hour of day, and whether the day is Monday to Friday."""
    return F.hour(leave_at).alias("hod"), F.dayofweek(leave_at).between(2, 6).alias("weekday")


def corridor_coverage(scored: DataFrame, min_samples: int = 5, version: str | None = None) -> DataFrame:
    """Coverage and sharpness by line, direction, hour and kind of day."""
    rows = scored if version is None else scored.where(F.col("predictor_version") == version)
    return rows.groupBy("line", "direction_code", *when_of()).agg(
        F.count("*").alias("n"), rounded(share(F.col("in_p80"))).alias("coverage_p80"), rounded(share(F.col("in_p90"))).alias("coverage_p90"),
        rounded(F.median(F.col("p80") - F.col("p50"))).alias("sharpness"), rounded(F.median("p50_residual")).alias("median_residual"),
    ).where(F.col("n") >= min_samples)


def uncovered_buckets(scored: DataFrame, target: int = 5) -> DataFrame:
    return scored.groupBy("line", "direction_code", *when_of()).agg(F.count("*").alias("n")).where(F.col("n") < target)


def calibration_rows(scored: DataFrame, min_confidence: float = 0.5, line: str | None = None, version: str | None = None) -> DataFrame:
    """Rows that calibration is judged on: resolved, fit to a log-normal, trusted enough."""
    ok = (F.col("status") == "resolved") & (F.col("p50") > 0) & (F.col("p80") > F.col("p50")) & F.col("actual").isNotNull()
    rows = scored.where(ok & (F.coalesce("truth_confidence", F.lit(0.0)) >= min_confidence))
    if line is not None:
        rows = rows.where(F.col("line") == line)
    return rows if version is None else rows.where(F.col("predictor_version") == version)


def reliability_curve(rows: DataFrame, min_samples: int = 30, pooled: bool = False, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Share of actuals at or below each fitted quantile; by line, or for all lines together.

    One aggregate with a conditional mean per level, turned into rows after the rows of a line have become one.
    """
    # the slack lets an actual that equals the quantile count, however the exponential was rounded
    below = [share(F.col("actual") <= lognormal_quantile(F.col("p50"), F.col("p80"), q) + 1e-6) for q in quantiles]
    line = F.lit("ALL") if pooled else F.col("line")
    wide = rows.groupBy(line.alias("line")).agg(F.count("*").alias("n"), *[b.alias(f"b{i}") for i, b in enumerate(below)])
    points = F.array(*[F.struct(F.lit(q).alias("nominal"), F.col(f"b{i}").alias("observed")) for i, q in enumerate(quantiles)])
    long = wide.where(F.col("n") >= (0 if pooled else min_samples)).select("line", "n", F.inline(points))
    return long.select("line", "n", "nominal", rounded(F.col("observed")).alias("observed"))


def pit_histogram(rows: DataFrame, n_bins: int = 10, min_samples: int = 30, pooled: bool = False) -> DataFrame:
    """Histogram of the probability integral transform; every bin of a line is there, empty ones with count 0.

    A value falls into a bin exactly if its normal score lies between the bin's edges, which are constants: no
    distribution function is computed per row, and a line's bins are conditional counts of one aggregate. An actual at
    p80, or as far below the median, lies on an edge: the last bits of the logarithms decide, so they are the C library's.
    """
    fits = (F.col("p50") > 0) & (F.col("p80") > F.col("p50"))
    z = F.when(fits, (F.col("__a") - F.col("__m")) / ((F.col("__h") - F.col("__m")) / Z80))
    edges = [NORMAL.inv_cdf(k / n_bins) for k in range(1, n_bins)]
    place = F.when(F.col("actual") <= 0, 0)
    for i, edge in enumerate(edges):
        place = place.when(z < edge, i)
    line = F.lit("ALL") if pooled else F.col("line")
    logs = {name: libm_log(F.col(c)) for name, c in (("__a", "actual"), ("__m", "p50"), ("__h", "p80"))}
    binned = rows.withColumns(logs).select(line.alias("line"), place.otherwise(n_bins - 1).alias("bin"))
    wide = binned.groupBy("line").agg(F.count("*").alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(n_bins)])
    bars = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("count")) for i in range(n_bins)])
    long = wide.where(F.col("n") >= (0 if pooled else min_samples)).select("line", "n", F.inline(bars))
    return long.select("line", "bin", "count", rounded(F.col("count") / F.col("n") * n_bins).alias("density"))


def pit_shape(histogram: DataFrame, n_bins: int = 10) -> DataFrame:
    """One word per line for the shape of its histogram."""
    k = max(1, n_bins // 5)
    even = k / n_bins
    total = F.sum("count")
    part = histogram.groupBy("line").agg(
        (F.sum(F.when(F.col("bin") < k, F.col("count")).otherwise(0)) / total).alias("left"),
        (F.sum(F.when(F.col("bin") >= n_bins - k, F.col("count")).otherwise(0)) / total).alias("right"),
    )
    left, right = F.col("left"), F.col("right")
    middle, expected = 1 - left - right, 1 - 2 * even
    shape = (
        F.when((F.abs(left - even) < 0.05) & (F.abs(right - even) < 0.05), "calibrated").when(left + right > 2.8 * even, "u-shape").when(middle > 1.4 * expected, "hump")
        .when((right > 1.6 * even) & (left < even), "right-skew").when((left > 1.6 * even) & (right < even), "left-skew").otherwise("mixed")
    )
    return part.select("line", shape.alias("shape"), rounded(left).alias("left_share"), rounded(right).alias("right_share"))


def failure_calibration(forecasts: DataFrame, failed: Column, n_bins: int = 10) -> DataFrame:
    """Predicted failure probability against how often it came true, in equal bins; 1.0 itself lies in none."""
    place = F.floor(F.col("failure_prob") * n_bins).cast("int")
    binned = forecasts.where((F.col("failure_prob") >= 0) & (F.col("failure_prob") < 1)).select(place.alias("bin"), "failure_prob", F.when(failed, 1.0).otherwise(0.0).alias("y"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("failure_prob")).alias("mean_predicted"), rounded(F.avg("y")).alias("observed"))


def reliability_bins(rows: DataFrame, score: Column, success: Column, n_bins: int = 10) -> DataFrame:
    """Per bin of a reliability score: mean score, success rate, Brier score and share of the calibration error."""
    bin_ = F.least(F.floor(score * n_bins), F.lit(n_bins - 1)).cast("int")
    made = rows.where(score.isNotNull() & success.isNotNull()).select(bin_.alias("bin"), score.alias("p"), success.cast("double").alias("y"))
    by = made.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.avg((F.col("p") - F.col("y")) ** 2).alias("b"))
    total = by.agg(F.sum("n").alias("total"))  # one row of a table of n_bins rows
    return by.join(F.broadcast(total)).select(
        "bin", "n", rounded(F.col("mp")).alias("mean_score"), rounded(F.col("my")).alias("success_rate"), rounded(F.col("b")).alias("brier"),
        rounded(F.col("n") / F.col("total") * F.abs(F.col("mp") - F.col("my"))).alias("ece_part"),
    )


def historical_quantiles(scored: DataFrame, keys: Sequence[str] = ("mode", "line", "direction_code"), last: int = 200, least: int = 5) -> DataFrame:
    """Nearest-rank quantiles of the last resolved outcomes of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.col("resolved_at").desc(), F.col("forecast_id").desc())
    rows = scored.where(F.col("status") == "resolved").select(*keys, "actual", "resolved_at", "forecast_id").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY actual)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rounded(q(0.5)).alias("p50"), rounded(q(0.8)).alias("p80"), rounded(q(0.9)).alias("p90"), F.min("resolved_at").alias("oldest"), F.max("resolved_at").alias("newest")).where(F.col("n") >= least)


def resolved_counts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows = scored.where(F.col("status") == "resolved")
    return rows.groupBy("mode", "line").agg(F.count("*").alias("n_resolved"), F.count_if(F.coalesce("truth_confidence", F.lit(0.0)) >= threshold).alias("n_confident"))


def corpus_summary(corridors: DataFrame, scored_left: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Corridors with their forecasts' counts, coverage and medians; corridors without forecasts stay.

    Forecasts are summed up by corridor first, then joined: the corridor side never meets single forecasts.
    """
    enough = F.coalesce("truth_confidence", F.lit(0.0)) >= threshold
    by = scored_left.groupBy("corridor_id").agg(
        F.count("forecast_id").alias("n_predictions"), F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count_if(F.col("status") == "unresolvable").alias("n_unresolvable"),
        rounded(F.avg(F.when(F.col("in_p80").isNotNull() & enough, F.when(F.col("in_p80"), 1.0).otherwise(0.0)))).alias("coverage_p80"),
        rounded(F.median(F.when(enough, F.col("p50_residual")))).alias("median_residual"), rounded(F.median("truth_confidence")).alias("median_confidence"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_predictions", "n_resolved", "n_unresolvable")}
    return corridors.join(by, "corridor_id", "left").withColumns(zero)


def corridor_rows(scored_left: DataFrame, corridor: str, limit: int = 50) -> DataFrame:
    """The newest forecasts of one corridor, resolved or not."""
    rows = scored_left.where(F.col("corridor_id") == corridor).orderBy(F.col("leave_at").desc(), F.col("forecast_id").desc()).limit(limit)
    return rows.select("forecast_id", "leave_at", "predictor_version", "direction_code", "p50", "p80", "p90", rounded(F.col("actual")).alias("actual"), "in_p80", rounded(F.col("p50_residual")).alias("p50_residual"), "truth_confidence", "status")


def available_predictors(scored: DataFrame, min_resolved: int = 1) -> DataFrame:
    return scored.where(F.col("status") == "resolved").groupBy("predictor_version").agg(F.count("*").alias("n_resolved")).where(F.col("n_resolved") >= min_resolved)


def scoreboard(scored: DataFrame, min_confidence: float = 0.5, min_samples: int = 30, mode: str | None = None) -> DataFrame:
    """Proper scores of each predictor by line and direction, from closed-form columns in one aggregate."""
    a, p50, p80, p90 = (F.col(c) for c in ("actual", "p50", "p80", "p90"))
    ok = (F.col("status") == "resolved") & F.col("predictor_version").isNotNull() & (p50 > 0) & (p80 >= p50) & a.isNotNull() & (F.coalesce("truth_confidence", F.lit(0.0)) >= min_confidence)
    rows = scored.where(ok) if mode is None else scored.where(ok & (F.col("mode") == mode))
    by = rows.groupBy("predictor_version", "line", "direction_code").agg(
        F.count("*").alias("n"), F.avg(crps(a, p50, p80, p90)).alias("crps"), F.avg(pinball(0.5, a, p50)).alias("pinball_50"), F.avg(pinball(0.8, a, p80)).alias("pinball_80"), F.avg(pinball(0.9, a, p90)).alias("pinball_90"),
        share(a <= p80).alias("coverage_80"), share(a <= p90).alias("coverage_90"), share(a > p90).alias("tail_miss"), F.avg(interval_score(a, p50, p90)).alias("interval"),
    ).where(F.col("n") >= min_samples)
    gap = F.abs(F.col("coverage_80") - 0.8)
    wide = by.withColumns({"coverage_gap": gap, "decision_loss": F.col("crps") + 0.05 * gap})
    return wide.select("predictor_version", "line", "direction_code", "n", *[rounded(F.col(c)).alias(c) for c in wide.columns[4:]])


def best_predictors(board: DataFrame) -> DataFrame:
    """Rank of the predictors of each line and direction by decision loss."""
    by = Window.partitionBy("line", "direction_code").orderBy("decision_loss", "predictor_version")
    return board.select("line", "direction_code", "predictor_version", "n", "decision_loss", F.row_number().over(by).alias("rank"))


def residual_quantiles(scored: DataFrame, keys: Sequence[str] = ("line", "direction_code", "horizon"), min_samples: int = 20, min_confidence: float = 0.5) -> DataFrame:
    """Cells of residual quantiles (linear interpolation), absolute error and bias."""
    levels = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    rows = scored.where((F.col("status") == "resolved") & (F.coalesce("truth_confidence", F.lit(0.0)) >= min_confidence))
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("p50_residual", F.array(*map(F.lit, levels))).alias("q"), rounded(F.avg(F.abs("p50_residual"))).alias("mae"), rounded(F.avg("p50_residual")).alias("bias"))
    return by.where(F.col("n") >= min_samples).select(*keys, "n", *[rounded(F.col("q")[i]).alias(f"q{round(100 * p):02d}") for i, p in enumerate(levels)], "mae", "bias")


def horizon_bin(seconds: Column) -> Column:
    """Name of the forecast horizon's class."""
    return (
        F.when(seconds.isNull(), "unknown").when(seconds < 0, "past").when(seconds < 120, "0_2m").when(seconds < 300, "2_5m").when(seconds < 600, "5_10m")
        .when(seconds < 1200, "10_20m").otherwise("20m_plus")
    )


def dot_positions(rows: DataFrame, n: int = 20, per_unit: float = 60.0) -> DataFrame:
    """Dots of a quantile dot plot: ``n`` evenly spaced quantiles per row, stacked where they fall into one unit."""
    grid = F.array(*[F.lit(NORMAL.inv_cdf((i + 0.5) / n)) for i in range(n)])
    dots = rows.select("forecast_id", lognormal_mu(F.col("p50")).alias("mu"), lognormal_sigma(F.col("p50"), F.col("p80")).alias("sigma"), F.posexplode(grid).alias("dot", "z"))
    placed = dots.select("forecast_id", "dot", F.exp(F.col("mu") + F.col("sigma") * F.col("z")).alias("position")).withColumn("unit", F.floor(F.col("position") / per_unit))
    stack = Window.partitionBy("forecast_id", "unit").orderBy("dot")
    return placed.select("forecast_id", "dot", rounded(F.col("position"), 4).alias("position"), "unit", F.row_number().over(stack).alias("height"))
