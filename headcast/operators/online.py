"""State that learns in order: conformal offsets, running moments, promotions.

A fold over one key's history is sequential by nature. Rows are dealt by key, sorted within partitions and streamed
through the fold, so a task holds one key's state rather than its history.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

STEPS = (1.0, 5.0, 20.0, 60.0)
ETA, BOUND = 0.05, 1200.0


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start: Callable[[tuple], Any], step: Callable[[Any, tuple], None], out: Callable[[tuple, Any], tuple]
) -> DataFrame:
    """One row per key: ``out(key, state)`` after ``step(state, values)`` for its rows in order, from ``start(key)``.

    ``values`` are the columns that aren't keys, as ``df`` has them; nulls are None, and a null key is a key.
    """
    rest = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    fields, width = T.StructType.fromDDL(schema), len(keys)
    types = [to_arrow_type(f.dataType) for f in fields]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            done, columns = [], [c.to_pylist() for c in batch.columns]
            for now, values in zip(zip(*columns[:width]), zip(*columns[width:])):
                if now != key or not begun:
                    if begun:
                        done.append(out(key, state))
                    key, state, begun = now, start(now), True
                step(state, values)
            if done:
                yield packed(done)
        if begun:
            yield packed([out(key, state)])

    return dealt.mapInArrow(run, fields)


class Conformal:
    """Offset of one quantile that follows its coverage, by a bank of step sizes weighted by their losses."""

    def __init__(self, target: float, remember: bool = False):
        self.target, self.remember = target, remember
        self.offset = self.step_size = 0.0
        self.n = self.missed = 0
        self.weights = [0.0] * len(STEPS)

    def update(self, raw: float, seen: float) -> None:
        self.update_all([(raw, seen)])

    def update_all(self, observed: Iterable[tuple[float, float]]) -> None:
        """Moves on by pairs of prediction and outcome in order; the four step sizes are written out, as this runs once a row."""
        target, lower, remember, exp = self.target, self.target - 1, self.remember, math.exp
        offset, size, n, missed = self.offset, self.step_size, self.n, self.missed
        w0, w1, w2, w3 = self.weights
        s0, s1, s2, s3 = STEPS
        for raw, seen in observed:
            if not remember:
                w0 = w1 = w2 = w3 = 0.0
            n += 1
            miss = target
            if seen <= max(0.0, raw + offset):
                miss = target - 1.0
            else:
                missed += 1
            gap = seen - raw
            e0, e1, e2, e3 = gap - (offset + s0 * miss), gap - (offset + s1 * miss), gap - (offset + s2 * miss), gap - (offset + s3 * miss)
            w0 -= ETA * (target * e0 if e0 > 0 else lower * e0)
            w1 -= ETA * (target * e1 if e1 > 0 else lower * e1)
            w2 -= ETA * (target * e2 if e2 > 0 else lower * e2)
            w3 -= ETA * (target * e3 if e3 > 0 else lower * e3)
            top = max(w0, w1, w2, w3)
            w0, w1, w2, w3 = w0 - top, w1 - top, w2 - top, w3 - top
            m0, m1, m2, m3 = exp(w0), exp(w1), exp(w2), exp(w3)
            size = sum((m0 * s0, m1 * s1, m2 * s2, m3 * s3)) / sum((m0, m1, m2, m3))
            offset = max(-BOUND, min(BOUND, offset + size * miss))
        self.offset, self.step_size, self.n, self.missed, self.weights = offset, size, n, missed, [w0, w1, w2, w3]


def known(value: float | None) -> bool:
    return value is not None and value == value


def conformal_offsets(observations: DataFrame, keys: Sequence[str], order: Sequence[str], remember: bool = False) -> DataFrame:
    """Offsets per key from rows with ``target``, ``raw`` and ``seen``; ``target`` is constant within a key. Rows with an
    unknown value don't count."""
    kinds = ", ".join(f"{k} {observations.schema[k].dataType.simpleString()}" for k in keys)

    def step(state: list, values: tuple) -> None:
        target, raw, seen = values[:3]
        if not state:
            state.append(Conformal(target, remember))
        if known(raw) and known(seen):
            state[0].update(raw, seen)

    return ordered_fold(
        observations.select(*keys, "target", "raw", "seen", *order), keys, order, f"{kinds}, offset_s double, step_size double, n bigint, missed bigint",
        lambda key: [], step, lambda key, s: (*key, s[0].offset, s[0].step_size, s[0].n, s[0].missed),
    )


def warm_up(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], last: int = 500, since: Column | None = None, remember: bool = False) -> DataFrame:
    """Conformal offsets replayed from the ``last`` outcomes of each key (after ``since``), oldest first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = outcomes if since is None else outcomes.where(F.col(order[0]) >= since)
    return conformal_offsets(rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last).drop("__n"), keys, order, remember)


def state_updates(outcomes: DataFrame, learners: str = "gbm-%", shifted: str = "kernel-v1+eb", mode: str = "l") -> DataFrame:
    """Which states an outcome moves: one row per (leg, quantile) with ``raw`` and ``seen``, ``kind`` naming the state.

    Learnt predictors (by the pattern ``learners``) have the 0.8 and 0.9 quantiles of their wait and total legs followed;
    the shifted kernel the mean residual of its wait's median. Other versions, modes and unknown values move nothing.
    ``outcomes``: keys, mode, predictor_version, wait_p50/p80/p90, total_p80/p90, actual_wait, actual_total.
    """
    leg = lambda kind, name, q, raw, seen: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("leg"), F.lit(q).alias("target"), F.col(raw).alias("raw"), F.col(seen).alias("seen"))
    conformal = F.array(*[leg("conformal", name, q, f"{name}_p{round(100 * q)}", f"actual_{name}") for name in ("wait", "total") for q in (0.8, 0.9)])
    shift = F.array(leg("shift", "wait", 0.5, "wait_p50", "actual_wait"))
    moved = F.when(F.col("predictor_version").like(learners), conformal).when(F.col("predictor_version") == shifted, shift)
    rows = outcomes.where(F.col("mode") == mode).withColumn("__u", F.explode(moved))
    return rows.select(*outcomes.columns, "__u.*").where("raw is not null and seen is not null and not isnan(raw) and not isnan(seen)")


def running_moments(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Count, mean and population variance, which merge across tasks; the batch form of the incremental update."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


class Promotion:
    """Which predictor serves a corridor: a challenger must win by a margin, several times in a row."""

    def __init__(self, default: str, margin: float = 0.005, wins: int = 2):
        self.active, self.margin, self.needed = default, margin, wins
        self.score: float | None = None
        self.pending: str | None = None
        self.streak = self.changes = 0

    def consider(self, candidate: str, score: float, incumbent_score: float | None) -> None:
        if self.score is None:
            self.score = incumbent_score
        if candidate == self.active:
            self.score, self.pending, self.streak = score, None, 0
        elif self.score is None or not score + self.margin < self.score:
            if self.pending == candidate:
                self.pending, self.streak = None, 0
        else:
            self.streak = self.streak + 1 if self.pending == candidate else 1
            self.pending = candidate
            if self.streak >= self.needed:
                self.active, self.score, self.pending, self.streak = candidate, score, None, 0
                self.changes += 1


def promotions(evaluations: DataFrame, default: str, margin: float = 0.005, wins: int = 2) -> DataFrame:
    """Active version per corridor after evaluations (corridor_id, at, candidate, score, incumbent_score) in order."""

    def step(state: Promotion, values: tuple) -> None:
        candidate, score, incumbent = values[:3]
        state.consider(candidate, score, incumbent if known(incumbent) else None)

    return ordered_fold(
        evaluations.select("corridor_id", "candidate", "score", "incumbent_score", "at"), ["corridor_id"], ["at", "candidate"],
        "corridor_id string, active string, decided_score double, pending string, streak bigint, changes bigint",
        lambda key: Promotion(default, margin, wins), step, lambda key, s: (*key, s.active, s.score, s.pending, s.streak, s.changes),
    )
