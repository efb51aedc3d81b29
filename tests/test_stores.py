"""Stored tables open only the parts that a batch lies in; schedule sets are replaced by archive; sliding order statistics."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headcast.operators import sinks, sliding, tables
from headcast.sources import static


def test_an_upsert_reads_and_rewrites_touched_parts_only(spark, tmp_path):
    path, schema, keys = f"{tmp_path}/t", "k long, v long, day string", ["k", "day"]
    first = spark.createDataFrame([(k, k, f"d{k % 4}") for k in range(40)], schema)
    merge = lambda a, b: sinks.overwrite(a, b.select(a.columns), keys, "v")
    tables.upsert_rows(first, path, schema, "day", keys, merge, 2)
    before = set(tables.stored(spark, path, schema, "day").inputFiles())
    batch = spark.createDataFrame([(1, 100, "d1"), (77, 7, "d9")], schema)
    fresh = tables.bucketed(batch, keys, 2)
    pruned = tables.touched(tables.stored(spark, path, schema, "day"), fresh, "day")
    plan = pruned._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert {r.day for r in pruned.collect()} == {"d1"} and pruned.count() < 11
    tables.upsert_rows(batch, path, schema, "day", keys, merge, 2)
    after = tables.stored(spark, path, schema, "day")
    # files of untouched parts are the same as before
    assert {f for f in before if "day=d1" not in f} <= set(after.inputFiles())
    assert {(r.k, r.v) for r in after.collect()} == {(k, k) for k in range(40) if k != 1} | {(1, 100), (77, 7)}
    # many parts are found by a join instead
    limit, tables.FEW_PARTS = tables.FEW_PARTS, 0
    try:
        assert tables.touched(after, fresh, "day").where("k = 1").count() == 1
    finally:
        tables.FEW_PARTS = limit


def test_sets_differ_in_headers_and_lose_tables(spark, tmp_path):
    def put(root, archive, **files):
        folder = tmp_path / root / "agency=metra" / f"archive={archive}"
        folder.mkdir(parents=True)
        for name, text in files.items():
            (folder / f"{name}.txt").write_text(text, encoding="utf-8")
        return str(tmp_path / root)

    store = str(tmp_path / "store")
    read = static.load_sets(spark, put("a", "1", stops='﻿stop_id,stop_name,stop_lat\nA,"Main, north",41.5\nB,,oops\nC\n', calendar="service_id,monday\nW,1\n", feed_info="feed_version,feed_publisher_name\n3,First\n4,Second\n", trips=""), store)
    assert (read["stops"], read["calendar"], read["routes"], read["feed_info"]) == (3, 1, 0, 1)
    stops = {r.stop_id: (r.stop_name, r.stop_lat, r.stop_lon) for r in static.stored_table(spark, store, "stops").collect()}
    assert stops == {"A": ("Main, north", 41.5, None), "B": (None, None, None), "C": (None, None, None)}
    static.load_sets(spark, put("b", "2", stops="stop_lat,stop_id\n40,Z\n"), store)
    static.load_sets(spark, put("c", "1", stops="stop_id\nQ\n"), store)
    got = {r.archive: (r.n_stops, r.n_calendar, r.feed_version) for r in static.set_totals(spark, store, ["stops", "calendar"]).collect()}
    # the calendar and the feed's own line went with the archive that had them
    assert got == {"1": (1, 0, None), "2": (1, 0, None)}
    with pytest.raises(ValueError):
        static.load_sets(spark, put("d", "x#y", stops="stop_id\nQ\n"), store)


def test_windows_equal_the_rows_themselves(spark):
    rng = random.Random(8)
    right = [(rng.choice("ab"), rng.randrange(400), float(rng.randrange(9)) if rng.random() < 0.9 else None, rng.random() < 0.3) for _ in range(300)] + [(None, 5, 1.0, True), ("a", None, 1.0, True)]
    left = [(i, rng.choice("abc"), rng.randrange(400)) for i in range(120)] + [(900, None, 3), (901, "a", None)]
    told = spark.createDataFrame(right, "k string, t long, v double, near boolean")
    asked = spark.createDataFrame(left, "id int, k string, at long")
    for low, high in ((-40, 0), (0, 90), (-7, 13)):
        got = {r.id: r for r in sliding.over_windows(asked, told, ["k"], F.col("at"), F.col("t"), low, high, sliding.Spread, ["v"]).collect()}
        assert len(got) == len(left)
        for i, k, at in left:
            inside = [v for q, t, v, _ in right if q == k and None not in (k, at, t) and at + low <= t <= at + high and v is not None]
            assert got[i].n_recent == len(inside)
            if len(inside) >= 3:
                assert abs(got[i].volatility - (np.percentile(inside, 75) - np.percentile(inside, 25)) / 1.349) < 1e-9
            else:
                assert got[i].volatility is None


def test_forty_departures_count_all(spark):
    """Medians of gaps over all departures of a window differ from those of its first 32."""
    at, times = 0, []
    for k in range(100):
        at += 100 if k < 32 else 1_000
        times.append(at)
    told = spark.createDataFrame([("s", t * 1_000_000, t == 100) for t in times], "k string, t long, near boolean")
    row = sliding.over_windows(spark.createDataFrame([(1, "s", 0)], "id int, k string, at long"), told, ["k"], F.col("at"), F.col("t"), 0, 10**12, sliding.Departures, ["near"]).first()
    gaps = np.diff(times)
    assert (row.first_at, row.first_near, row.n_gaps, row.gap, row.first_gap, row.rest) == (100_000_000, True, 99, float(np.median(gaps)), 100.0, float(np.median(gaps[1:])))
    assert float(np.median(gaps)) != float(np.median(gaps[:31]))
    rng = random.Random(2)
    for n in range(1, 9):
        own = sorted(rng.sample(range(1000), n))
        window = sliding.Departures()
        for t in own:
            window.push(t * 1_000_000, (False,))
        for gone in range(n):
            left = own[gone:]
            want = np.diff(left)
            _, _, count, gap, first, rest = window.answer()
            assert count == len(want) and (gap, first) == ((float(np.median(want)), float(want[0])) if len(want) else (None, None))
            assert rest == (float(np.median(want[1:])) if len(want) > 1 else None)
            window.pop()
