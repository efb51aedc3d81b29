"""Queries over what is stored in parts: schedule sets by archive, snapshots appended, totals and latest rows upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.functions.scores import rounded
from headcast.operators import sinks, tables
from headcast.sources import proxies, static
from headcast.sources.proxies import sql
from headcast.streaming.replay import fresh_folder


def write_sets(rows: DataFrame, root: str, archive: str, table: str) -> None:
    """``rows`` (agency and the file's columns) as one CSV file per agency below ``root``."""
    spark, aside = rows.sparkSession, fresh_folder(rows.sparkSession, "sets")
    rows.repartition("agency").write.partitionBy("agency").option("header", True).csv(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{aside}/agency=*/part-*")):
        folder = path(root, f"{part.getPath().getParent().getName()}/archive={archive}")
        fs.mkdirs(folder)
        fs.rename(part.getPath(), path(folder, f"{table}.txt"))


def a29_static_sets(s: SparkSession, d: str) -> DataFrame:
    """Two archives per agency (regions), the first of which comes a second time with less in it."""
    nation = proxies.table(s, d, "nation").join(proxies.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("agency"))
    customer = proxies.table(s, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = proxies.table(s, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    stops = customer.select("agency", key.alias("stop_id"), F.when(key % 5 != 0, F.col("c_name")).alias("stop_name"), F.when(key % 7 == 0, "north").otherwise((41 + key / 1000).cast("string")).alias("stop_lat"), F.lit("more").alias("unknown_column"))
    routes = supplier.select("agency", F.lit(3).alias("route_type"), F.col("s_suppkey").alias("route_id"))
    info = nation.groupBy("agency").agg(F.concat(F.lit("Feed of "), "agency").alias("feed_publisher_name"), F.lit("7").alias("feed_version"), F.lit("").alias("feed_start_date"))
    roots, store = [fresh_folder(s, "archives") for _ in range(3)], fresh_folder(s, "store")
    for root, archive, some in ((roots[0], "v1", F.lit(True)), (roots[1], "v2", key % 3 == 0), (roots[2], "v1", key % 2 == 0)):
        write_sets(stops.where(some), root, archive, "stops")
        if archive == "v1":
            write_sets(routes if root == roots[0] else routes.where("agency <> 'ASIA'"), root, archive, "routes")
        else:
            # the same columns in another order, for two agencies only
            write_sets(routes.select("agency", "route_id", "route_type").where("agency like 'A%'"), root, archive, "routes")
        write_sets(info.where(F.col("agency") != "EUROPE"), root, archive, "feed_info")
        static.load_sets(s, root, store)
    totals = static.set_totals(s, store, ["stops", "routes", "calendar"])
    seen = static.stored_table(s, store, "stops").groupBy(*static.KEYS).agg(F.count("stop_name").alias("n_named"), F.count("stop_lat").alias("n_placed"), rounded(F.coalesce(F.sum("stop_lat"), F.lit(0.0)), 3).alias("lat_sum"))
    kinds = static.stored_table(s, store, "routes").groupBy(*static.KEYS).agg(F.sum("route_type").alias("types"))
    out = totals.join(seen, static.KEYS).join(kinds, static.KEYS, "left")
    return out.select(*static.KEYS, "n_stops", "n_routes", "n_calendar", "n_named", "n_placed", "lat_sum", F.coalesce("types", F.lit(0)).alias("types"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("feed_publisher_name", "feed_version", "feed_start_date")])


SNAPSHOT = "event_id bigint, line string, run bigint, station bigint, polled_at timestamp_ntz, day date"
TOTALS = "line string, station bigint, n bigint, mean double, low double, high double, day date"
LATEST = "line string, run bigint, event_id bigint, station bigint, polled_at timestamp_ntz"


def _thirds(df: DataFrame) -> list[DataFrame]:
    """A table in three batches by event, overlapping in time."""
    return [df.where(F.col("event_id") % 3 == k) for k in range(3)]


def k1_appended(s: SparkSession, d: str) -> DataFrame:
    """Snapshots appended batch by batch, and read back for some days: only these days' files are opened."""
    path = fresh_folder(s, "snapshots")
    for batch in _thirds(proxies.arrivals(s, d).select("event_id", "line", "run", "station", "polled_at", F.to_date("polled_at").alias("day"))):
        tables.append_rows(batch, path, "day", ["line", "run"], 2)
    return tables.stored(s, path, SNAPSHOT, "day").where("day between '2024-01-05' and '2024-01-09'").drop(tables.BUCKET).withColumn("day", F.col("day").cast("string"))


def k5_stored_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals per line, station and day, accumulated in a stored table by three upserts."""
    path = fresh_folder(s, "totals")
    for batch in _thirds(proxies.arrivals(s, d).withColumn("day", F.to_date("polled_at"))):
        value = (F.unix_micros(F.col("arrival_at").cast("timestamp")) - F.unix_micros(F.col("polled_at").cast("timestamp"))) / 1e6
        by = batch.groupBy("line", "station", "day").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select("line", "station", "n", "mean", "low", "high", "day")
        tables.upsert_rows(by, path, TOTALS, "day", ["line", "station", "day"], lambda a, b: sinks.accumulate(a, b, ["line", "station", "day"]), 2)
    return tables.stored(s, path, TOTALS, "day").select("line", "station", F.col("day").cast("string").alias("day"), "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "low", "high")])


def k3_stored_latest(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each run, overwritten on conflict in a stored table by three upserts."""
    path = fresh_folder(s, "latest")
    for batch in _thirds(proxies.arrivals(s, d)):
        rows = batch.select("line", "run", "event_id", "station", "polled_at").groupBy("line", "run").agg(F.max_by(F.struct("event_id", "station", "polled_at"), F.struct("polled_at", "event_id")).alias("r")).select("line", "run", "r.*")
        tables.upsert_rows(rows, path, LATEST, "line", ["line", "run"], lambda a, b: sinks.overwrite(a.select(b.columns), b, ["line", "run"], "polled_at"), 4)
    return tables.stored(s, path, LATEST, "line").drop(tables.BUCKET)


QUERIES = {f.__name__: f for f in (a29_static_sets, k1_appended, k3_stored_latest, k5_stored_totals)}

PER_ARCHIVE = """SELECT r_name AS agency, archive, c_custkey AS k, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('v1', 2), ('v2', 3)) a(archive, m) WHERE c_custkey % m = 0"""
ROUTES = """SELECT r_name AS agency, archive, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('v1'), ('v2')) a(archive)
  WHERE (archive = 'v1' AND r_name <> 'ASIA') OR (archive = 'v2' AND r_name LIKE 'A%') GROUP BY ALL"""
ORACLE = {
    "a29_static_sets": f"""SELECT s.agency, s.archive, count(*) AS n_stops, coalesce(any_value(r.n), 0) AS n_routes, CAST(0 AS BIGINT) AS n_calendar, count(*) FILTER (WHERE k % 5 <> 0) AS n_named, count(*) FILTER (WHERE k % 7 <> 0) AS n_placed,
      round(coalesce(sum(41 + k / 1000.0::DOUBLE) FILTER (WHERE k % 7 <> 0), 0), 3) AS lat_sum, CAST(3 * coalesce(any_value(r.n), 0) AS BIGINT) AS types, CASE WHEN s.agency = 'EUROPE' THEN 'none' ELSE 'Feed of ' || s.agency END AS feed_publisher_name,
      CASE WHEN s.agency = 'EUROPE' THEN 'none' ELSE '7' END AS feed_version, 'none' AS feed_start_date FROM ({PER_ARCHIVE}) s LEFT JOIN ({ROUTES}) r ON r.agency = s.agency AND r.archive = s.archive GROUP BY s.agency, s.archive""",
    "k1_appended": sql("SELECT event_id, line, run, station, polled_at, CAST(CAST(polled_at AS DATE) AS VARCHAR) AS day FROM arrivals WHERE CAST(polled_at AS DATE) BETWEEN '2024-01-05' AND '2024-01-09'", "arrivals"),
    "k3_stored_latest": sql("SELECT line, run, event_id, station, polled_at FROM (SELECT *, row_number() OVER (PARTITION BY line, run ORDER BY polled_at DESC, event_id DESC) AS n FROM arrivals) WHERE n = 1", "arrivals"),
    "k5_stored_totals": sql("""SELECT line, station, CAST(day AS VARCHAR) AS day, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high
      FROM (SELECT line, station, CAST(polled_at AS DATE) AS day, (epoch_us(arrival_at) - epoch_us(polled_at)) / 1e6 AS v FROM arrivals) GROUP BY line, station, day""", "arrivals"),
}
