"""Quantile trees against exhaustive search over the rows themselves; frames and splits on awkward rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from headcast.operators import training, trees


def loss(y, w, q):
    """Least weighted pinball loss over all constants that occur."""
    return min((sum(k * max(q * (v - c), (q - 1) * (v - c)) for v, k in zip(y, w)) for c in set(y)), default=0.0)


def quantile(y, w, q):
    order, upto = sorted(zip(y, w)), 0.0
    for v, k in order:
        upto += k
        if upto >= q * sum(w) - 1e-9:
            return v
    return None


def grow(rows, q, depth, least, node=1):
    """{node: (feature, threshold) or value} by trying every value of every feature."""
    y, w = [r[1] for r in rows], [r[2] for r in rows]
    best = None
    if depth:
        for f in range(len(rows[0][0])):
            # every value but the largest splits; unknown ones are below all
            for t in sorted({-math.inf if r[0][f] is None else r[0][f] for r in rows})[:-1]:
                left = [r for r in rows if (-math.inf if r[0][f] is None else r[0][f]) <= t]
                right = [r for r in rows if not (-math.inf if r[0][f] is None else r[0][f]) <= t]
                if len(left) < least or len(right) < least:
                    continue
                gain = loss(y, w, q) - sum(loss([r[1] for r in part], [r[2] for r in part], q) for part in (left, right))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, t, left, right)
    if best is None:
        return {node: quantile(y, w, q)}
    return {node: (best[1], best[2]), **grow(best[3], q, depth - 1, least, 2 * node), **grow(best[4], q, depth - 1, least, 2 * node + 1)}


def small_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.choice([None, 1.0, 2.0, 3.0, 5.0]), float(rng.randrange(6)), float(rng.random() < 0.5)]
        y = float(rng.randrange(4) + (6 if (x[0] or 0) > 2 else 0) + (3 if x[1] > 3 and x[2] else 0))
        rows.append((k, "wait", f"L{k % 2}", x, y, rng.choice([0.5, 1.0])))
    return rows


def test_trees_equal_exhaustive_search(spark):
    rows = small_rows(1)
    frame = spark.createDataFrame(rows, "id long, leg string, line string, x array<double>, y double, w double")
    model = trees.fit_trees(frame, 3, (0.5, 0.9), depth=3, least=8, feature_bins=200, label_bins=400, least_rows=20)
    got = {}
    for r in model.collect():
        got.setdefault((r.line, r.q), {})[r.node] = (r.feature, r.threshold) if r.feature is not None else r.value
    for line in ("L0", "L1"):
        for q in (0.5, 0.9):
            want = grow([(r[3], r[4], r[5]) for r in rows if r[2] == line], q, 3, 8)
            assert got[line, q].keys() == want.keys()
            # edges of bins are quantiles: a threshold may lie between the values that it parts
            for node, v in want.items():
                mine = got[line, q][node]
                assert (mine[0] == v[0] and mine[1] >= v[1] - 1e-9) if isinstance(v, tuple) else mine == v
    ends = trees.with_nodes(frame, model, (0.5, 0.9), 3, value=True).collect()
    for r in ends:
        tree, node = got[r.line, r.q], 1
        while isinstance(tree[node], tuple):
            f, t = tree[node]
            node = 2 * node + (0 if (-math.inf if r.x[f] is None else r.x[f]) <= t else 1)
        assert (r.node, r.value) == (node, tree[node])


def test_validation_and_order_of_quantiles(spark):
    rows = small_rows(2)
    frame = spark.createDataFrame(rows, "id long, leg string, line string, x array<double>, y double, w double")
    model = trees.fit_trees(frame, 3, depth=2, least=5, least_rows=20)
    seen = {(r.line, r.q): r for r in trees.validated(frame, model, depth=2).collect()}
    value = {(r.id, r.q): r.value for r in trees.with_nodes(frame, model, (0.5, 0.8, 0.9), 2, value=True).collect()}
    for line in ("L0", "L1"):
        own = [r for r in rows if r[2] == line]
        for q in (0.5, 0.8, 0.9):
            errors = [r[4] - value[r[0], q] for r in own]
            assert math.isclose(seen[line, q].pinball, np.mean([max(q * e, (q - 1) * e) for e in errors]))
            assert seen[line, q].n_val == len(own)
    offsets = spark.createDataFrame([("wait", "L0", 0.8, -50.0), ("wait", "L1", 0.9, 3.0)], "leg string, line string, q double, offset_s double")
    for r in trees.leg_quantiles(frame, model, F.lit(2.0), offsets, depth=2).collect():
        a, b, c = (2.0 + value[r.id, q] for q in (0.5, 0.8, 0.9))
        a, b, c = max(0, a), max(0, a, b), max(0, a, b, c)
        b, c = (b - 50.0, c) if r.line == "L0" else (b, c + 3.0)
        assert (r.p50, r.p80, r.p90) == (a, max(a, b), max(a, b, c))


def test_small_groups_get_no_tree_and_empty_frames_no_model(spark):
    frame = spark.createDataFrame(small_rows(3, 30), "id long, leg string, line string, x array<double>, y double, w double")
    assert trees.fit_trees(frame, 3, least_rows=16).isEmpty()
    assert trees.fit_trees(frame.limit(0), 3).isEmpty()
    assert trees.leg_quantiles(frame, trees.fit_trees(frame, 3, least_rows=16), F.lit(1.0)).isEmpty()


def test_split_by_rows_equals_a_sort(spark):
    rng = random.Random(7)
    begin = dt.datetime(2024, 1, 1)
    rows = [(k, begin + dt.timedelta(hours=rng.choice([1, 1, 1, 30, 31, 55]), seconds=rng.randrange(3)) if k % 11 else None) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    for share, least in ((0.1, 20), (0.5, 20), (0.01, 40), (0.1, 151), (0.1, 400)):
        order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or begin, r[0]))
        size = max(int(300 * share), least) if 300 > least else 0
        want = {r[0] for r in order[300 - size :]} if size and 300 - size >= least else set()
        assert {r.id for r in training.row_split(frame, "at", "id", share, least).where("is_validation").collect()} == want


def test_frames_fall_back_and_leave_out_near_rows(spark):
    at = dt.datetime(2024, 1, 6, 7, 30)
    base = ["l", "A", "N", "v", "resolved", at]
    rows = [
        (1, *base, at - dt.timedelta(seconds=100), '{"seconds_until_next_arrival": 95.5, "line": "B", "hour_of_day": 3}', 10.0, 20.0, 15.0, None, 0.6),
        (2, *base, at - dt.timedelta(seconds=100), "{bad", None, None, 15.0, 30.0, 0.6), (3, *base, None, '{"seconds_until_next_arrival": "NaN"}', 1.0, 1.0, 2.0, 3.0, 0.6),
        (4, *base, at - dt.timedelta(seconds=80), None, 10.0, 20.0, 15.0, 5.0, 0.6), (5, *base, at, '{"seconds_until_next_arrival": 20}', 10.0, 20.0, 15.0, 5.0, 0.6),
        (6, *base, at, '{"seconds_until_next_arrival": 200}', 10.0, 20.0, 15.0, 5.0, None), (7, *base, at, '{"seconds_until_next_arrival": 200}', 10.0, 20.0, None, 5.0, 0.9),
    ]
    schema = "forecast_id long, mode string, line string, direction_code string, predictor_version string, status string, leave_at timestamp_ntz, snapshot_polled_at timestamp_ntz, feature_json string, "
    schema += "kernel_wait_p50 double, kernel_in_vehicle_mean double, actual_wait double, actual_in_vehicle double, truth_confidence double"
    got = {r.forecast_id: r for r in training.leg_frame(spark.createDataFrame(rows, schema), ["v"]).collect()}
    assert {i: (r.line, r.hour_of_day, r.weekday, r.horizon_s, r.residual_wait_s, r.residual_in_vehicle_s) for i, r in got.items()} == {
        1: ("B", 3, False, 95.5, 5.0, None), 2: ("A", 7, False, 100.0, 15.0, 30.0), 3: ("A", 7, False, None, 1.0, 2.0),
    }
