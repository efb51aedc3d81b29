"""Feeds of the observatory, projected from the driver's star schema with arithmetic that SQL can repeat.

Each function reads only the columns it needs, so the scans stay narrow. ``SQL`` holds the same views as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mode(key: Column) -> Column:
    return F.when(key % 4 == 0, "l").when(key % 4 == 1, "bus").when(key % 4 == 2, "metra").otherwise("intercampus")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile forecasts: one row per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    p50 = (F.lit(300) + 10 * (key % 97)).cast("double")
    return table(spark, sf_dir, "orders").select(
        key.alias("forecast_id"), _mode(cust).alias("mode"), F.col("o_orderpriority").alias("line"), F.col("o_orderstatus").alias("direction_code"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(cust % 24).cast("int"))).alias("leave_at"),
        F.concat(F.lit("pv"), key % 3).alias("predictor_version"), p50.alias("p50"), (p50 * 1.25).alias("p80"), (p50 * 1.4).alias("p90"),
        F.when(key % 10 == 0, "pending").when(key % 10 == 1, "unresolvable").otherwise("resolved").alias("status"),
        F.concat(F.lit("c"), cust % 50).alias("corridor_id"), ((key % 100) / F.lit(100.0)).alias("failure_prob"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened: one row per order with items; counted and summed before anything is exchanged."""
    n = F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("forecast_id")).agg(
        (F.lit(200.0) + 20 * F.sum("l_quantity") / n).alias("actual"), (F.least(n, F.lit(8)) / 8.0).alias("truth_confidence"), F.max("l_shipdate").alias("resolved_at")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction snapshots: one row per event."""
    k = _k()
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("line"), (F.col("user_id") % 30).alias("run"), (k % 20).alias("station"), F.col("ts").alias("polled_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias("arrival_at"),
        (k % 5 == 0).alias("approaching"), (k % 17 == 0).alias("fault"), (k % 7 == 0).alias("delayed"), (k % 11 == 0).alias("scheduled"),
        F.when(F.col("user_id") % 2 == 0, "north").otherwise("south").alias("direction_code"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions: view and click events."""
    k = _k()
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select(
        "event_id", F.col("event_type").alias("line"), (F.col("user_id") % 30).alias("run"), F.col("user_id").alias("vehicle"), (k % 20).alias("station"), F.col("ts").alias("polled_at"),
        (F.lit(41.8) + (k % 50) / 1000.0).alias("lat"), (F.lit(-87.6) - (F.col("user_id") % 50) / 1000.0).alias("lon"), (k % 3 == 0).alias("approaching"),
        F.when(F.col("user_id") % 2 == 0, "north").otherwise("south").alias("direction_code"), (k % 17 == 0).alias("fault"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query log: view events as origin and destination lookups."""
    k = _k()
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        F.col("event_id").alias("query_id"), F.col("ts").alias("queried_at"), (F.col("user_id") % 10).alias("origin"), (k % 10).alias("destination"), (k % 9 != 0).alias("success")
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll ledger: one row per event."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), (_k() % 13 != 0).alias("ok"), F.col("ts").alias("responded_at"))


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors: one per value of the order side's corridor key."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("n")).distinct().select(
        F.concat(F.lit("c"), "n").alias("corridor_id"), _mode(F.col("n")).alias("mode"), (F.col("n") % 3).alias("priority")
    )


def _k() -> Column:
    """The number in an event's properties."""
    return F.get_json_object("props", "$.k").cast("bigint")


#: The same views for the oracle.
SQL = {
    "forecasts": """SELECT o_orderkey AS forecast_id,
  CASE o_custkey % 4 WHEN 0 THEN 'l' WHEN 1 THEN 'bus' WHEN 2 THEN 'metra' ELSE 'intercampus' END AS mode,
  o_orderpriority AS line, o_orderstatus AS direction_code, o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24)::INTEGER AS leave_at,
  'pv' || (o_orderkey % 3) AS predictor_version, CAST(300 + 10 * (o_orderkey % 97) AS DOUBLE) AS p50,
  CAST(300 + 10 * (o_orderkey % 97) AS DOUBLE) * 1.25::DOUBLE AS p80, CAST(300 + 10 * (o_orderkey % 97) AS DOUBLE) * 1.4::DOUBLE AS p90,
  CASE o_orderkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'unresolvable' ELSE 'resolved' END AS status,
  'c' || (o_custkey % 50) AS corridor_id, (o_orderkey % 100) / 100.0::DOUBLE AS failure_prob FROM orders""",
    "outcomes": """SELECT l_orderkey AS forecast_id, 200.0::DOUBLE + 20 * sum(l_quantity) / count(*) AS actual,
  least(count(*), 8) / 8.0::DOUBLE AS truth_confidence, max(l_shipdate) AS resolved_at FROM lineitem GROUP BY l_orderkey""",
    "scored": """SELECT f.*, o.actual, o.truth_confidence, o.resolved_at, o.actual <= f.p80 AS in_p80, o.actual <= f.p90 AS in_p90,
  o.actual - f.p50 AS p50_residual, o.actual - f.p80 AS p80_residual FROM outcomes o JOIN forecasts f USING (forecast_id)""",
    "k_events": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "arrivals": """SELECT event_id, event_type AS line, user_id % 30 AS run, k % 20 AS station, ts AS polled_at,
  ts + INTERVAL 1 SECOND * floor(value)::INTEGER AS arrival_at, k % 5 = 0 AS approaching, k % 17 = 0 AS fault, k % 7 = 0 AS delayed,
  k % 11 = 0 AS scheduled, CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS direction_code FROM k_events""",
    "positions": """SELECT event_id, event_type AS line, user_id % 30 AS run, user_id AS vehicle, k % 20 AS station, ts AS polled_at,
  41.8::DOUBLE + (k % 50) / 1000.0::DOUBLE AS lat, -87.6::DOUBLE - (user_id % 50) / 1000.0::DOUBLE AS lon, k % 3 = 0 AS approaching,
  CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS direction_code, k % 17 = 0 AS fault FROM k_events WHERE event_type IN ('view', 'click')""",
    "requests": "SELECT event_id AS query_id, ts AS queried_at, user_id % 10 AS origin, k % 10 AS destination, k % 9 <> 0 AS success FROM k_events WHERE event_type = 'view'",
    "polls": "SELECT event_type AS endpoint, k % 13 <> 0 AS ok, ts AS responded_at FROM k_events",
    "corridors": """SELECT 'c' || n AS corridor_id, CASE n % 4 WHEN 0 THEN 'l' WHEN 1 THEN 'bus' WHEN 2 THEN 'metra' ELSE 'intercampus' END AS mode, n % 3 AS priority
  FROM (SELECT DISTINCT c_custkey % 60 AS n FROM customer)""",
}
#: Views that a view is made of.
NEEDS = {"scored": ("forecasts", "outcomes"), "arrivals": ("k_events",), "positions": ("k_events",), "requests": ("k_events",), "polls": ("k_events",)}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` over the named proxy views, as one statement; ``more`` names further views of the statement itself."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    parts = [f"{name} AS ({SQL[name]})" for name in ordered] + [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles along patterns: one observation per event."""
    k = _k()
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("vid"), (F.col("user_id") % 5).cast("int").alias("pid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), (100.0 * k).alias("pdist"),
        (k % 120).cast("double").alias("age_s"), (F.lit(41.8) + (k % 50) / 1000.0).alias("lat"), (F.lit(-87.6) - (F.col("user_id") % 50) / 1000.0).alias("lon"), F.when(k % 4 != 0, (k * 3.6)).alias("heading"),
    )


def pattern_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns: the nations of a region in key order, a thousand feet apart. A dimension of 25 rows."""
    seq = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pid"), "n_nationkey", seq.alias("seq"))
    return rows.select("pid", "seq", F.col("n_nationkey").alias("stop"), (1000.0 * F.col("seq")).alias("pdist"), (F.lit(41.8) + F.col("seq") / 100.0).alias("lat"), (F.lit(-87.6) - F.col("pid") / 100.0).alias("lon"))


def trip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests with both ends: one per event."""
    k = _k()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("line"), (k % 20).alias("board"), ((k + F.col("user_id")) % 20).alias("alight"), F.col("ts").alias("leave_at")
    )


SQL |= {
    "vehicles": """SELECT event_id, user_id AS vid, CAST(user_id % 5 AS INTEGER) AS pid, epoch_us(ts) / 1e6 AS at_s, 100.0::DOUBLE * k AS pdist, CAST(k % 120 AS DOUBLE) AS age_s,
  41.8::DOUBLE + (k % 50) / 1000.0::DOUBLE AS lat, -87.6::DOUBLE - (user_id % 50) / 1000.0::DOUBLE AS lon, CASE WHEN k % 4 <> 0 THEN k * 3.6::DOUBLE END AS heading FROM k_events""",
    "pattern_points": """SELECT pid, seq, n_nationkey AS stop, 1000.0::DOUBLE * seq AS pdist, 41.8::DOUBLE + seq / 100.0::DOUBLE AS lat, -87.6::DOUBLE - pid / 100.0::DOUBLE AS lon
  FROM (SELECT n_regionkey AS pid, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seq FROM nation)""",
    "trip_requests": "SELECT event_id AS request_id, event_type AS line, k % 20 AS board, (k + user_id) % 20 AS alight, ts AS leave_at FROM k_events",
}
NEEDS |= {"vehicles": ("k_events",), "trip_requests": ("k_events",)}
