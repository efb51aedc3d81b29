"""Static schedule sets: many files per agency and archive, loaded together, kept by archive, replaced as a whole."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: The files of a set with their columns, as the public format names them.
TABLES = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_phone string, agency_fare_url string, agency_email string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_desc string, stop_lat double, stop_lon double, zone_id string, stop_url string, location_type int, "
    "parent_station string, stop_timezone string, wheelchair_boarding int, platform_code string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, route_type int, route_url string, route_color string, route_text_color string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, direction_id int, block_id string, shape_id string, wheelchair_accessible int, bikes_allowed int",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, stop_headsign string, pickup_type int, drop_off_type int, shape_dist_traveled double, timepoint int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled double",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "feed_info": "feed_publisher_name string, feed_version string, feed_start_date string, feed_end_date string",
}
KEYS = ["agency", "archive"]


def _columns(table: str) -> dict[str, str]:
    return dict(c.split() for c in TABLES[table].split(", "))


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def set_files(spark: SparkSession, root: str, table: str, archives: Sequence[tuple[str, str]] | None = None) -> list[str]:
    """The files of ``table`` below ``root`` (``agency=A/archive=B/table.txt``), of the given archives or of all."""
    pattern = _path(spark, root, "agency=*", "archive=*", f"{table}.txt")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = sorted(f.getPath().toString() for f in found or [])
    wanted = None if archives is None else {f"/agency={a}/archive={b}/" for a, b in archives}
    return [p for p in paths if wanted is None or any(w in p for w in wanted)]


def read_sets(spark: SparkSession, root: str, table: str, archives: Sequence[tuple[str, str]] | None = None) -> DataFrame | None:
    """Rows of ``table`` of all archives, with ``agency`` and ``archive`` from where the file lies; None without a file.

    Files are read together if their first lines agree: a column's place may differ from file to file. Missing columns, empty
    texts and values of another type become null, further columns go, lines of another width keep what they have.
    """
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path in set_files(spark, root, table, archives):
        by_header[tuple(spark.read.csv(path, header=True).columns)].append(path)
    out = None
    for header, paths in sorted(by_header.items()):
        if not header:
            continue
        names = [h.removeprefix("\ufeff").strip() for h in header]
        raw = spark.read.schema(", ".join(f"`c{i}` string" for i in range(len(names)))).csv(paths, header=True, mode="PERMISSIVE")
        at = {name: f"c{i}" for i, name in reversed(list(enumerate(names)))}
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        part = lambda key: F.regexp_extract(plain, f"/{key}=([^/]*)/", 1).alias(key)
        value = lambda c, kind: (F.nullif(F.col(at[c]), F.lit("")).try_cast(kind) if c in at else F.lit(None).cast(kind)).alias(c)
        rows = raw.select(*map(part, KEYS), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("place"), *[value(c, k) for c, k in _columns(table).items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def load_sets(spark: SparkSession, root: str, store: str, archives: Sequence[tuple[str, str]] | None = None) -> dict[str, int]:
    """Loads sets into ``store``: a table per file, parts by agency and archive. Returns the rows read per table.

    An archive that was loaded before is replaced as a whole, tables that it has no more included; others stay untouched.
    """
    read = {}
    fresh = {t: read_sets(spark, root, t, archives) for t in TABLES}
    named = {tuple(p.split("/agency=")[1].split("/")[0:2]) for t in TABLES for p in set_files(spark, root, t, archives)}
    odd = sorted(n for pair in named for n in pair if re.search(r"[^\w .-]", n.removeprefix("archive=")))
    if odd:
        raise ValueError(f"names of agencies and archives are letters, digits, spaces, dots and dashes: {odd}")
    for table, rows in fresh.items():
        for agency, archive in named:
            part = _path(spark, store, table, f"agency={agency}", archive)
            part.getFileSystem(spark._jsc.hadoopConfiguration()).delete(part, True)
        if rows is None:
            read[table] = 0
            continue
        seen = Observation(table)
        kept = first_rows(rows) if table == "feed_info" else rows.drop("place")
        kept.observe(seen, F.count("*").alias("n")).repartition(*KEYS).write.mode("append").partitionBy(*KEYS).parquet(f"{store}/{table}")
        read[table] = int(seen.get["n"])
    return read


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each file."""
    order = Window.partitionBy("place.file_path").orderBy("place.file_block_start", "place.id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "place")


def stored_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A loaded table; empty, with its columns, if no archive had one."""
    schema = f"{TABLES[table]}, agency string, archive string"
    path = _path(spark, store, table)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{store}/{table}") if there else spark.createDataFrame([], schema)


def set_totals(spark: SparkSession, store: str, counted: Sequence[str]) -> DataFrame:
    """Per agency and archive the rows of each table, and what its feed says about itself."""
    total = lambda t: stored_table(spark, store, t).groupBy(*KEYS).agg(F.count("*").alias(f"n_{t}"))
    tables = [total(t) for t in counted]
    info = stored_table(spark, store, "feed_info")
    out = tables[0]
    for t in (*tables[1:], info):
        out = out.join(t, KEYS, "full")
    zero: list[Column] = [F.coalesce(f"n_{t}", F.lit(0)).alias(f"n_{t}") for t in counted]
    return out.select(*KEYS, *zero, *[c for c in info.columns if c not in KEYS])
