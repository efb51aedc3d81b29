"""Queries of the calibration family, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions.scores import NORMAL, Z80, interval_score, lognormal_mu, lognormal_quantile, lognormal_sigma, pinball, rounded
from headcast.operators import calibration as op
from headcast.sources import proxies
from headcast.sources.proxies import sql


def scored(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    return op.score_join(proxies.forecasts(spark, sf_dir), proxies.outcomes(spark, sf_dir), how)


GOOD = "status = 'resolved' AND p50 > 0 AND p80 > p50 AND actual IS NOT NULL AND coalesce(truth_confidence, 0) >= 0.25"
HOD = "CAST(extract(hour FROM leave_at) AS INTEGER) AS hod, extract(dow FROM leave_at) BETWEEN 1 AND 5 AS weekday"
L = {q: f"greatest({q}::DOUBLE * (actual - p{round(q * 100)}), ({q}::DOUBLE - 1) * (actual - p{round(q * 100)}))" for q in (0.5, 0.8, 0.9)}
CRPS = f"2 * (0.15::DOUBLE * ({L[0.5]} + {L[0.8]}) + 0.05::DOUBLE * ({L[0.8]} + {L[0.9]}) + 0.5::DOUBLE * {L[0.5]} + 0.1::DOUBLE * {L[0.9]})"
INTERVAL = "(p90 - p50) + 4 * (greatest(0, p50 - actual) + greatest(0, actual - p90))"
FIT = f"ln(p50) AS mu, (ln(p80) - ln(p50)) / {Z80!r}::DOUBLE AS sigma"
PIT_BIN = "CASE WHEN actual <= 0 THEN 0 " + " ".join(f"WHEN (ln(actual) - mu) / sigma < {NORMAL.inv_cdf(k / 10)!r}::DOUBLE THEN {k - 1}" for k in range(1, 10)) + " ELSE 9 END"
BOARD = f"""SELECT predictor_version, line, direction_code, count(*) AS n, avg({CRPS}) AS crps, avg({L[0.5]}) AS pinball_50, avg({L[0.8]}) AS pinball_80,
  avg({L[0.9]}) AS pinball_90, avg(CASE WHEN actual <= p80 THEN 1.0 ELSE 0.0 END) AS coverage_80, avg(CASE WHEN actual <= p90 THEN 1.0 ELSE 0.0 END) AS coverage_90,
  avg(CASE WHEN actual > p90 THEN 1.0 ELSE 0.0 END) AS tail_miss, avg({INTERVAL}) AS "interval" FROM scored
  WHERE status = 'resolved' AND p50 > 0 AND p80 >= p50 AND coalesce(truth_confidence, 0) >= 0.25 GROUP BY ALL HAVING count(*) >= 5"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scoreboard(scored(spark, sf_dir), 0.25, 5)


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.calibration_rows(scored(spark, sf_dir), 0.25)


def _curve_sql(line: str, least: int) -> str:
    points = " UNION ALL ".join(
        f"SELECT {line} AS line, count(*) AS n, {q!r}::DOUBLE AS nominal, round(avg(CASE WHEN actual <= exp(mu + sigma * {NORMAL.inv_cdf(q)!r}::DOUBLE) + 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM fit GROUP BY {'line' if line == 'line' else '1'} HAVING count(*) >= {least}"
        for q in op.QUANTILES
    )
    return sql(f"SELECT * FROM ({points})", "scored", fit=f"SELECT *, {FIT} FROM scored WHERE {GOOD}")


def _pit_sql(line: str, least: int, body: str = "SELECT line, bin, count, density FROM hist") -> str:
    return sql(
        body, "scored", fit=f"SELECT *, {FIT} FROM scored WHERE {GOOD}", binned=f"SELECT {line} AS line, {PIT_BIN} AS bin FROM fit",
        lines=f"SELECT line, count(*) AS n FROM binned GROUP BY line HAVING count(*) >= {least}",
        hist="""SELECT l.line, CAST(s.bin AS INTEGER) AS bin, count(b.bin) AS count, round(count(b.bin) / any_value(l.n) * 10.0::DOUBLE, 6) AS density
          FROM lines l CROSS JOIN (SELECT unnest(range(10)) AS bin) s LEFT JOIN binned b ON b.line = l.line AND b.bin = s.bin GROUP BY l.line, s.bin""",
    )


SHAPE = """SELECT line, CASE WHEN abs(l - 0.2) < 0.05 AND abs(r - 0.2) < 0.05 THEN 'calibrated' WHEN l + r > 2.8 * 0.2 THEN 'u-shape' WHEN 1 - l - r > 1.4 * 0.6 THEN 'hump'
  WHEN r > 1.6 * 0.2 AND l < 0.2 THEN 'right-skew' WHEN l > 1.6 * 0.2 AND r < 0.2 THEN 'left-skew' ELSE 'mixed' END AS shape, round(l, 6) AS left_share, round(r, 6) AS right_share
  FROM (SELECT line, sum(CASE WHEN bin < 2 THEN count ELSE 0 END)::DOUBLE / sum(count) AS l, sum(CASE WHEN bin >= 8 THEN count ELSE 0 END)::DOUBLE / sum(count) AS r FROM hist GROUP BY line)"""


def g19_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and coverage of the whole store, as one row: single-row aggregates side by side."""
    f = proxies.forecasts(spark, sf_dir).agg(
        F.count("*").alias("n_forecasts"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "unresolvable").alias("n_unresolvable"), F.min(F.when(F.col("status") == "pending", F.col("leave_at"))).alias("oldest_pending")
    )
    o = scored(spark, sf_dir).agg(F.count("*").alias("n_outcomes"), rounded(op.share(F.col("in_p80"))).alias("coverage_p80"))
    a = proxies.arrivals(spark, sf_dir).agg(F.count("*").alias("n_arrivals"), F.max("polled_at").alias("latest_poll"))
    return f.join(F.broadcast(o)).join(F.broadcast(a))


def s_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p50, p80, p90 = (F.col(c) for c in ("actual", "p50", "p80", "p90"))
    return good(spark, sf_dir).select(
        "forecast_id", rounded(op.crps(a, p50, p80, p90)).alias("crps"), rounded(pinball(0.9, a, p90)).alias("pinball_90"), rounded(interval_score(a, p50, p90)).alias("interval"), (a > p90).alias("tail_miss"),
        rounded(lognormal_mu(p50)).alias("mu"), rounded(lognormal_sigma(p50, p80)).alias("sigma"), rounded(p90 - lognormal_quantile(p50, p80, 0.9), 5).alias("p90_fit_residual"),
    )


QUERIES = {
    "g1_corridor_coverage": lambda s, d: op.corridor_coverage(scored(s, d)),
    "g2_uncovered_buckets": lambda s, d: op.uncovered_buckets(scored(s, d)),
    "g4_reliability_curve": lambda s, d: op.reliability_curve(good(s, d)),
    "g5_reliability_pooled": lambda s, d: op.reliability_curve(good(s, d), pooled=True),
    "g6_pit_histogram": lambda s, d: op.pit_histogram(good(s, d)),
    "g7_pit_pooled": lambda s, d: op.pit_histogram(good(s, d), pooled=True),
    "g8_pit_shape": lambda s, d: op.pit_shape(op.pit_histogram(good(s, d))),
    "g9_failure_calibration": lambda s, d: op.failure_calibration(proxies.forecasts(s, d), F.col("status") == "unresolvable"),
    "g10_historical_quantiles": lambda s, d: op.historical_quantiles(scored(s, d)),
    "g12_resolved_counts": lambda s, d: op.resolved_counts(scored(s, d)),
    "g13_corpus_summary": lambda s, d: op.corpus_summary(proxies.corridors(s, d), scored(s, d, "left"), 0.25),
    "g14_corridor_rows": lambda s, d: op.corridor_rows(scored(s, d, "left"), "c7"),
    "g15_available_predictors": lambda s, d: op.available_predictors(scored(s, d)),
    "g17_scoreboard": board,
    "g18_best_predictors": lambda s, d: op.best_predictors(board(s, d)),
    "g19_status": g19_status,
    "g21_residual_quantiles": lambda s, d: op.residual_quantiles(scored(s, d).withColumn("horizon", op.horizon_bin(F.col("p50") - 200)), min_confidence=0.25),
    "f14_reliability_bins": lambda s, d: op.reliability_bins(scored(s, d), F.col("failure_prob"), ~F.col("in_p80")),
    "f40_dot_positions": lambda s, d: op.dot_positions(proxies.forecasts(s, d).where(F.col("status") == "pending")),
    "s20_scores": s_scores,
}

ORACLE = {
    "g1_corridor_coverage": sql(f"""SELECT line, direction_code, {HOD}, count(*) AS n, round(avg(CASE WHEN in_p80 THEN 1.0 ELSE 0.0 END), 6) AS coverage_p80,
      round(avg(CASE WHEN in_p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage_p90, round(median(p80 - p50), 6) AS sharpness, round(median(p50_residual), 6) AS median_residual
      FROM scored GROUP BY ALL HAVING count(*) >= 5""", "scored"),
    "g2_uncovered_buckets": sql(f"SELECT line, direction_code, {HOD}, count(*) AS n FROM scored GROUP BY ALL HAVING count(*) < 5", "scored"),
    "g4_reliability_curve": _curve_sql("line", 30),
    "g5_reliability_pooled": _curve_sql("'ALL'", 0),
    "g6_pit_histogram": _pit_sql("line", 30),
    "g7_pit_pooled": _pit_sql("'ALL'", 0),
    "g8_pit_shape": _pit_sql("line", 30, SHAPE),
    "g9_failure_calibration": sql("""SELECT CAST(floor(failure_prob * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(failure_prob), 6) AS mean_predicted,
      round(avg(CASE WHEN status = 'unresolvable' THEN 1.0 ELSE 0.0 END), 6) AS observed FROM forecasts WHERE failure_prob >= 0 AND failure_prob < 1 GROUP BY 1""", "forecasts"),
    "g10_historical_quantiles": sql("""SELECT mode, line, direction_code, count(*) AS n, round(quantile_disc(actual, 0.5), 6) AS p50, round(quantile_disc(actual, 0.8), 6) AS p80, round(quantile_disc(actual, 0.9), 6) AS p90,
      min(resolved_at) AS oldest, max(resolved_at) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY mode, line, direction_code ORDER BY resolved_at DESC, forecast_id DESC) AS rn FROM scored WHERE status = 'resolved')
      WHERE rn <= 200 GROUP BY ALL HAVING count(*) >= 5""", "scored"),
    "g12_resolved_counts": sql("SELECT mode, line, count(*) AS n_resolved, count(*) FILTER (WHERE coalesce(truth_confidence, 0) >= 0.5) AS n_confident FROM scored WHERE status = 'resolved' GROUP BY ALL", "scored"),
    "g13_corpus_summary": sql("""SELECT c.corridor_id, c.mode, c.priority, count(q.forecast_id) AS n_predictions, count(*) FILTER (WHERE q.status = 'resolved') AS n_resolved,
      count(*) FILTER (WHERE q.status = 'unresolvable') AS n_unresolvable, round(avg(CASE WHEN o.in_p80 IS NOT NULL AND coalesce(o.truth_confidence, 0) >= 0.25 THEN (CASE WHEN o.in_p80 THEN 1.0 ELSE 0.0 END) END), 6) AS coverage_p80,
      round(median(CASE WHEN coalesce(o.truth_confidence, 0) >= 0.25 THEN o.p50_residual END), 6) AS median_residual, round(median(o.truth_confidence), 6) AS median_confidence
      FROM corridors c LEFT JOIN forecasts q ON q.corridor_id = c.corridor_id LEFT JOIN scored o ON o.forecast_id = q.forecast_id GROUP BY ALL""", "scored", "corridors"),
    "g14_corridor_rows": sql("""SELECT f.forecast_id, f.leave_at, f.predictor_version, f.direction_code, f.p50, f.p80, f.p90, round(o.actual, 6) AS actual, o.actual <= f.p80 AS in_p80, round(o.actual - f.p50, 6) AS p50_residual,
      o.truth_confidence, f.status FROM forecasts f LEFT JOIN outcomes o USING (forecast_id) WHERE f.corridor_id = 'c7' ORDER BY f.leave_at DESC, f.forecast_id DESC LIMIT 50""", "forecasts", "outcomes"),
    "g15_available_predictors": sql("SELECT predictor_version, count(*) AS n_resolved FROM scored WHERE status = 'resolved' GROUP BY ALL", "scored"),
    "g17_scoreboard": sql("""SELECT predictor_version, line, direction_code, n, round(crps, 6) AS crps, round(pinball_50, 6) AS pinball_50, round(pinball_80, 6) AS pinball_80, round(pinball_90, 6) AS pinball_90,
      round(coverage_80, 6) AS coverage_80, round(coverage_90, 6) AS coverage_90, round(tail_miss, 6) AS tail_miss, round("interval", 6) AS "interval", round(abs(coverage_80 - 0.8), 6) AS coverage_gap,
      round(crps + 0.05 * abs(coverage_80 - 0.8), 6) AS decision_loss FROM board""", "scored", board=BOARD),
    "g18_best_predictors": sql("""SELECT line, direction_code, predictor_version, n, decision_loss, CAST(row_number() OVER (PARTITION BY line, direction_code ORDER BY decision_loss, predictor_version) AS INTEGER) AS rank
      FROM (SELECT *, round(crps + 0.05 * abs(coverage_80 - 0.8), 6) AS decision_loss FROM board)""", "scored", board=BOARD),
    "g19_status": sql("""SELECT (SELECT count(*) FROM forecasts) AS n_forecasts, (SELECT count(*) FROM forecasts WHERE status = 'pending') AS n_pending, (SELECT count(*) FROM forecasts WHERE status = 'unresolvable') AS n_unresolvable,
      (SELECT min(leave_at) FROM forecasts WHERE status = 'pending') AS oldest_pending, (SELECT count(*) FROM scored) AS n_outcomes, (SELECT round(avg(CASE WHEN in_p80 THEN 1.0 ELSE 0.0 END), 6) FROM scored) AS coverage_p80,
      (SELECT count(*) FROM arrivals) AS n_arrivals, (SELECT max(polled_at) FROM arrivals) AS latest_poll""", "scored", "arrivals"),
    "g21_residual_quantiles": sql("SELECT line, direction_code, horizon, count(*) AS n, " + ", ".join(f"round(quantile_cont(p50_residual, {p}), 6) AS q{round(100 * p):02d}" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + """,
      round(avg(abs(p50_residual)), 6) AS mae, round(avg(p50_residual), 6) AS bias FROM (SELECT *, CASE WHEN p50 - 200 < 0 THEN 'past' WHEN p50 - 200 < 120 THEN '0_2m' WHEN p50 - 200 < 300 THEN '2_5m' WHEN p50 - 200 < 600 THEN '5_10m'
      WHEN p50 - 200 < 1200 THEN '10_20m' ELSE '20m_plus' END AS horizon FROM scored WHERE status = 'resolved' AND coalesce(truth_confidence, 0) >= 0.25) GROUP BY ALL HAVING count(*) >= 20""", "scored"),
    "f14_reliability_bins": sql("""SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS success_rate, round(avg((p - y) * (p - y)), 6) AS brier,
      round(count(*) / (SELECT count(*)::DOUBLE FROM rows_) * abs(avg(p) - avg(y)), 6) AS ece_part FROM rows_ GROUP BY bin""", "scored",
      rows_="SELECT CAST(least(floor(failure_prob * 10), 9) AS INTEGER) AS bin, failure_prob AS p, CASE WHEN in_p80 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM scored WHERE failure_prob IS NOT NULL AND in_p80 IS NOT NULL"),
    "f40_dot_positions": sql("""SELECT forecast_id, dot, round(position, 4) AS position, CAST(floor(position / 60) AS BIGINT) AS unit, CAST(row_number() OVER (PARTITION BY forecast_id, floor(position / 60) ORDER BY dot) AS INTEGER) AS height
      FROM (SELECT forecast_id, dot, exp(ln(p50) + (ln(p80) - ln(p50)) / """ + f"{Z80!r}::DOUBLE" + " * z) AS position FROM forecasts CROSS JOIN (VALUES " + ", ".join(f"({i}, {NORMAL.inv_cdf((i + 0.5) / 20)!r}::DOUBLE)" for i in range(20)) + ") g(dot, z) WHERE status = 'pending')", "forecasts"),
    "s20_scores": sql(f"""SELECT forecast_id, round({CRPS}, 6) AS crps, round({L[0.9]}, 6) AS pinball_90, round({INTERVAL}, 6) AS "interval", actual > p90 AS tail_miss, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
      round(p90 - exp(mu + sigma * {NORMAL.inv_cdf(0.9)!r}::DOUBLE), 5) AS p90_fit_residual FROM (SELECT *, {FIT} FROM scored WHERE {GOOD})""", "scored"),
}
