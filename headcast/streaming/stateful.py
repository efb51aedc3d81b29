"""Keyed state with event-time timers: arrivals settled from evidence, forecasts resolved or given up, folds kept in a store.

Each processor sees one key's new rows at a time and keeps that key's state in the state store (RocksDB, checkpointed to the
shared folder), so a lost executor's state is restored elsewhere. Rows older than the watermark never arrive. Timers fire
once the watermark has passed them, when nothing earlier can come any more: what they give equals a batch over the rows
that arrived.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from headcast.operators.online import Conformal, Promotion, known

SECOND = 1_000_000
#: Stands for an unknown whole number on the way to the workers, where a column of longs with gaps would become doubles.
NONE = -(1 << 63)


def _millis(micros: int) -> int:
    """The first millisecond not before a time."""
    return -(-micros // 1000)


def _micros(column: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(column).cast("timestamp")), F.lit(NONE))


def _frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    """Objects rather than numpy types, so that whole numbers with gaps stay whole."""
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object") for i, n in enumerate(names)})


def _plain(value: Any) -> Any:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, int) and value == NONE else value


def _rows(parts: Iterator[pd.DataFrame], columns: Sequence[str]) -> list[tuple]:
    return [tuple(map(_plain, row)) for part in parts for row in part[list(columns)].itertuples(index=False, name=None)]


def _listed(column: pd.Series) -> list:
    """A column's plain values; numbers without gaps need no look at each."""
    whole = not column.isna().any() if column.dtype.kind == "f" else column.dtype.kind == "i" and not (column == NONE).any()
    return column.tolist() if whole else [_plain(v) for v in column]


# arrivals

SAMPLE = ("kind", "polled_us", "arrival_us", "approaching", "direction_code")
#: A stay of a vehicle at a stop: bounds, count, and of each kind of evidence the newest with its sort key.
STAY = (
    "first_us bigint, last_us bigint, n bigint, p1 bigint, p2_poll bigint, p2 bigint, p3_poll bigint, p3 bigint, "
    "d0_poll bigint, d0 string, d1_poll bigint, d1_arrival bigint, d1 string"
)
OBSERVED = (
    "line string, run bigint, station bigint, observed_us bigint, inferred_from string, direction_code string, "
    "first_seen_us bigint, last_seen_us bigint, sample_count bigint"
)


def _later(a: tuple, b: tuple) -> tuple:
    """The greater of two (key ..., value) tuples whose first element is null where there is none."""
    none = (a[0] is None, b[0] is None)
    if any(none):
        return b if none[0] else a
    return max(a, b, key=lambda t: tuple((x is not None, x) for x in t))


def _joined(a: tuple, b: tuple) -> tuple:
    """Two stays as one."""
    p1 = _later((a[3],), (b[3],))
    p2, p3, d0, d1 = (_later(a[i:j], b[i:j]) for i, j in ((4, 6), (6, 8), (8, 10), (10, 13)))
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *p1, *p2, *p3, *d0, *d1)


def _stay_of(sample: tuple, horizon_us: int) -> tuple:
    """The stay that one sample makes. Predictions further ahead than the horizon are no evidence of an arrival."""
    kind, polled, arrival, near, direction = sample
    moved, known_way = kind == "position", bool(direction)
    p1 = polled if moved and near else None
    p2 = (polled, arrival) if not moved and near and arrival is not None else (None, None)
    p3 = (polled, arrival) if not moved and arrival is not None and arrival <= polled + horizon_us else (None, None)
    d0 = (polled, direction) if moved and known_way else (None, None)
    d1 = (polled, arrival, direction) if not moved and known_way else (None, None, None)
    return (polled, polled, 1, p1, *p2, *p3, *d0, *d1)


class SettleArrivals(StatefulProcessor):
    """Stays of one (line, run, station): samples no more than the horizon apart. A stay's timer stands at its end; it fires
    when the watermark passes, and the best evidence of the stay is given out once."""

    def __init__(self, horizon_s: int):
        self.horizon_us = horizon_s * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stays = handle.getListState("stays", STAY)

    def _end(self, stay: tuple) -> int:
        return _millis(stay[1] + self.horizon_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = sorted(tuple(s) for s in self.stays.get()) if self.stays.exists() else []
        fresh = [_stay_of(s, self.horizon_us) for s in _rows(rows, SAMPLE)]
        stays: list[tuple] = []
        for stay in sorted([*before, *fresh], key=lambda s: s[:3]):
            if stays and stay[0] - stays[-1][1] <= self.horizon_us:
                stays[-1] = _joined(stays[-1], stay)
            else:
                stays.append(stay)
        ends = {self._end(s) for s in stays}
        for gone in {self._end(s) for s in before} - ends:
            self.handle.deleteTimer(gone)
        for end in ends:
            self.handle.registerTimer(end)
        self.stays.put(stays)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        stays = [tuple(s) for s in self.stays.get()] if self.stays.exists() else []
        left = [s for s in stays if self._end(s) > now]
        done = [r for s in stays if self._end(s) <= now if (r := self._observed(key, s))]
        self.stays.put(left) if left else self.stays.clear()
        if done:
            yield _frame(done, [f.split()[0] for f in OBSERVED.split(", ")])

    def _observed(self, key: tuple, stay: tuple) -> tuple | None:
        first, last, n, p1, _, p2, _, p3, _, d0, _, _, d1 = stay
        found = [(p1, "positions:approaching"), (p2, "arrivals:approaching"), (p3, "arrivals:dropoff")]
        best = next(((at, source) for at, source in found if at is not None), None)
        return None if best is None else (*map(_plain, key), *best, d0 or d1, first, last, n)

    def close(self) -> None:
        pass


def settled_arrivals(arrivals: DataFrame, positions: DataFrame, horizon_s: int = 21_600, late: str = "2 days") -> DataFrame:
    """Observed arrivals of two streams, each given out once, when no evidence can join its stay any more.

    ``arrivals``: line, run, station, polled_at, arrival_at, approaching, fault, direction_code; ``positions`` the same without
    arrival_at. As in the batch form an approaching position counts most, then an approaching prediction, then the last
    prediction whose time has passed; rows with a known or unknown fault don't count as predictions. Times are microseconds.
    """
    keys = ["line", "run", "station"]
    common = [*keys, F.col("polled_at").cast("timestamp").alias("at"), _micros("polled_at").alias("polled_us"), "approaching", "direction_code"]
    told = arrivals.where(~F.col("fault")).select(*common, _micros("arrival_at").alias("arrival_us"), F.lit("arrival").alias("kind"))
    seen = positions.where("station is not null").select(*common, F.lit(NONE).alias("arrival_us"), F.lit("position").alias("kind"))
    samples = told.unionByName(seen).where("line is not null and run is not null and station is not null").withWatermark("at", late)
    return samples.groupBy(*keys).transformWithStateInPandas(SettleArrivals(horizon_s), OBSERVED, "append", "eventTime")


# forecasts

QUESTION = ("kind", "request_id", "at_us", "due_us")
ANSWER = "line string, station bigint, request_id bigint, status string, settled_us bigint, wait_us bigint"


class SettleForecasts(StatefulProcessor):
    """Pending forecasts of one (line, station) and the arrivals that may answer them.

    A forecast is settled ``buffer_s`` after it is due. By then all arrivals up to it have come: the first one at or after
    the forecast's start resolves it, without one it is unresolvable. Arrivals are kept while a forecast may need them. A key
    has one timer, at the earliest such time: what the watermark has passed is settled together, with one look at the lists.
    """

    def __init__(self, buffer_s: int):
        self.buffer_us = buffer_s * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "request_id bigint, at_us bigint, due_us bigint")
        self.arrived = handle.getListState("arrived", "at_us bigint")

    def _end(self, due: int) -> int:
        return _millis(due + self.buffer_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _rows(rows, QUESTION)
        asked = [r[1:] for r in fresh if r[0] == "forecast"]
        if asked:
            first, standing = self._end(min(due for _, _, due in asked)), [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
            if not standing or first < min(standing):
                for later in standing:
                    self.handle.deleteTimer(later)
                self.handle.registerTimer(first)
            self.pending.appendList(asked)
        came = [(r[2],) for r in fresh if r[0] == "arrival"]
        if came:
            self.arrived.appendList(came)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, done, left = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], []
        arrived = sorted({a[0] for a in self.arrived.get()}) if self.arrived.exists() else []
        for request, at, due in self.pending.get() if self.pending.exists() else []:
            if self._end(due) > now:
                left.append((request, at, due))
                continue
            place = bisect_left(arrived, at)
            first = arrived[place] if place < len(arrived) else None
            if first is not None and first <= due + self.buffer_us:
                done.append((*map(_plain, key), request, "resolved", max(due, first), first - at))
            else:
                done.append((*map(_plain, key), request, "unresolvable", due + self.buffer_us, None))
        self.pending.put(left) if left else self.pending.clear()
        if left:
            self.handle.registerTimer(self._end(min(due for _, _, due in left)))
        # forecasts yet to come start after the watermark
        since = min([at for _, at, _ in left] + [timerValues.getCurrentWatermarkInMs() * 1000])
        kept = [(a,) for a in arrived[bisect_left(arrived, since) :]]
        self.arrived.put(kept) if kept else self.arrived.clear()
        if done:
            yield _frame(done, [f.split()[0] for f in ANSWER.split(", ")])

    def close(self) -> None:
        pass


def settled_forecasts(forecasts: DataFrame, arrivals: DataFrame, buffer_s: int = 300, late: str = "2 days") -> DataFrame:
    """Each forecast (line, station, request_id, leave_at, resolve_after) as resolved, with its wait, or unresolvable.

    ``arrivals``: line, station, arrived_at. A forecast is given out once; rows with null keys or times are left out.
    """
    keys = ["line", "station"]
    asked = forecasts.select(*keys, F.lit("forecast").alias("kind"), "request_id", F.col("leave_at").cast("timestamp").alias("at"), _micros("leave_at").alias("at_us"), _micros("resolve_after").alias("due_us"))
    none = F.lit(NONE)
    came = arrivals.select(*keys, F.lit("arrival").alias("kind"), none.alias("request_id"), F.col("arrived_at").cast("timestamp").alias("at"), _micros("arrived_at").alias("at_us"), none.alias("due_us"))
    rows = asked.unionByName(came).where(f"line is not null and station is not null and at is not null and (kind = 'arrival' or due_us <> {NONE})").withWatermark("at", late)
    return rows.groupBy(*keys).transformWithStateInPandas(SettleForecasts(buffer_s), ANSWER, "append", "eventTime")


MET = "request_id bigint, leave_us bigint, event_id bigint"


class MeetForecasts(StatefulProcessor):
    """Pairs of the forecasts of one key and stretch of time with the arrivals within ``wait_s`` after them.

    Forecasts (id, time, whether met) and arrivals (id, time) that may still meet are kept as arrays. New rows meet the kept ones
    and each other by binary search, and pairs leave in frames of ``frame_rows``, so a task holds a stretch and never its pairs. The
    watermark ends a forecast's wait: one that nothing met is then given out without. A stretch has one timer, at its next such time.
    """

    def __init__(self, wait_s: int, frame_rows: int = 100_000):
        self.wait_us, self.frame_rows = wait_s * SECOND, frame_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "asked binary, came binary")

    def _kept(self) -> tuple[np.ndarray, np.ndarray]:
        asked, came = self.open.get() if self.open.exists() else (b"", b"")
        return np.frombuffer(asked, dtype=np.int64).reshape(-1, 3).copy(), np.frombuffer(came, dtype=np.int64).reshape(-1, 2)

    def _pairs(self, asked: np.ndarray, came: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of all of both; marks the forecasts met."""
        came = came[np.argsort(came[:, 1], kind="stable")]
        first = np.searchsorted(came[:, 1], asked[:, 1], "left")
        many = np.searchsorted(came[:, 1], asked[:, 1] + self.wait_us, "right") - first
        asked[:, 2] |= many > 0
        upto = np.cumsum(many)
        for begin in range(0, int(upto[-1]) if len(upto) else 0, self.frame_rows):
            at = np.arange(begin, min(begin + self.frame_rows, upto[-1]))
            row = np.searchsorted(upto, at, "right")
            event = first[row] + at - (upto[row] - many[row])
            yield pd.DataFrame({"request_id": asked[row, 0], "leave_us": asked[row, 1], "event_id": came[event, 0]})

    def _settled(self, asked: np.ndarray, came: np.ndarray, now: int) -> Iterator[pd.DataFrame]:
        """Gives out what waited in vain, keeps what may still meet, and sets the timer."""
        ends = (asked[:, 1] + self.wait_us) // 1000 + 1
        vain = asked[(ends <= now) & (asked[:, 2] == 0)]
        asked, ends, came = asked[ends > now], ends[ends > now], came[came[:, 1] > now * 1000]
        for standing in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(standing)
        if len(asked) or len(came):
            self.open.update((asked.tobytes(), came.tobytes()))
            # of arrivals alone: when no forecast before them can come any more
            self.handle.registerTimer(int(ends.min()) if len(asked) else _millis(int(came[:, 1].max())))
        else:
            self.open.clear()
        if len(vain):
            yield pd.DataFrame({"request_id": vain[:, 0], "leave_us": vain[:, 1], "event_id": pd.array([pd.NA] * len(vain), dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, came = self._kept()
        parts = [(part["asks"].to_numpy(dtype=bool), part[["id", "at_us"]].to_numpy(dtype=np.int64)) for part in rows]
        asks, fresh = (np.concatenate(c) for c in zip(*parts))
        new, new_came = np.column_stack([fresh[asks], np.zeros(asks.sum(), dtype=np.int64)]), fresh[~asks]
        yield from self._pairs(asked, new_came)
        came = np.concatenate([came, new_came])
        yield from self._pairs(new, came)
        yield from self._settled(np.concatenate([asked, new]), came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(*self._kept(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def met_forecasts(forecasts: DataFrame, arrivals: DataFrame, wait_s: int = 7200, late: str = "1 hour", stretch: int = 12) -> DataFrame:
    """Forecasts (request_id, key, leave_at) with each arrival (event_id, a_key, arrived_at) of their key within ``wait_s`` after them.

    A forecast that none came for is given out with a null event once the lesser of both watermarks has passed its wait. A key is
    split into stretches of ``stretch`` waits; an arrival is given to its own, and to the one before if that may still wait for it.
    ids are whole numbers. Rows without an id or a time are left out; a missing key meets nothing.
    """
    width = wait_s * SECOND * stretch
    own = lambda us: F.floor(us / width)
    at = lambda column: F.col(column).cast("timestamp").alias("at")
    asked = forecasts.where("leave_at is not null and request_id is not null").select(F.col("key"), F.col("request_id").cast("long").alias("id"), at("leave_at"), F.lit(True).alias("asks"))
    came = arrivals.where("arrived_at is not null and event_id is not null and a_key is not null").select(F.col("a_key").alias("key"), F.col("event_id").cast("long").alias("id"), at("arrived_at"), F.lit(False).alias("asks"))
    both = asked.withWatermark("at", late).unionByName(came.withWatermark("at", late)).withColumn("at_us", F.unix_micros("at"))
    dealt = F.when(F.col("asks"), F.array(own(F.col("at_us")))).otherwise(F.array_distinct(F.array(own(F.col("at_us")), own(F.col("at_us") - wait_s * SECOND))))
    rows = both.withColumn("stretch", F.explode(dealt))
    return rows.groupBy("key", "stretch").transformWithStateInPandas(MeetForecasts(wait_s), MET, "append", "eventTime")


# folds


class KeptFold(StatefulProcessor):
    """A sequential state per key in the store: read, moved by the batch's rows in order, written back, and given out."""

    def __init__(self, order: Sequence[str], columns: Sequence[str], state: str, out: Sequence[str], ttl_s: int | None):
        self.order, self.columns, self.state_schema, self.out, self.ttl_s = list(order), list(columns), state, list(out), ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema, None if self.ttl_s is None else self.ttl_s * 1000)

    def start(self, kept: tuple | None) -> Any:
        raise NotImplementedError

    def step(self, fold: Any, values: tuple) -> None:
        raise NotImplementedError

    def moved(self, fold: Any, columns: list[list]) -> None:
        for values in zip(*columns):
            self.step(fold, values)

    def packed(self, fold: Any) -> tuple:
        raise NotImplementedError

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = _rows(iter([initialState]), self.out)
        if rows:
            self.state.update(self.packed(self.start(rows[-1])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold = self.start(tuple(self.state.get()) if self.state.exists() else None)
        # a batch's rows count in order, whatever order they come in; they are held as columns of numbers, not as objects
        frame = pd.concat([part[[*self.order, *self.columns]] for part in rows], ignore_index=True)
        frame = frame.sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
        for begin in range(0, len(frame), 10_000):
            part = frame.iloc[begin : begin + 10_000]
            self.moved(fold, [_listed(part[c]) for c in self.columns])
        kept = self.packed(fold)
        self.state.update(kept)
        yield _frame([(*map(_plain, key), *kept)], [*self.key_names, *self.out])

    def close(self) -> None:
        pass

    key_names: Sequence[str] = ("key",)


def _clock(ttl_s: int | None) -> str:
    """Forgetting needs the processing clock; with it a stream has work as long as it runs, so stop it rather than await its end."""
    return "none" if ttl_s is None else "processingTime"


class KeptPromotion(KeptFold):
    """The promotion streak of a corridor."""

    key_names = ("corridor_id",)

    def __init__(self, default: str, margin: float, wins: int, ttl_s: int | None):
        super().__init__(["at", "candidate"], ["__candidate", "score", "incumbent_score"], PROMOTION, [f.split()[0] for f in PROMOTION.split(", ")], ttl_s)
        self.default, self.margin, self.wins = default, margin, wins

    def start(self, kept: tuple | None) -> Promotion:
        fold = Promotion(self.default, self.margin, self.wins)
        if kept is not None:
            fold.active, fold.score, fold.pending, fold.streak, fold.changes = kept
        return fold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the candidate is a value as well as part of the order
        return super().handleInputRows(key, (part.assign(__candidate=part["candidate"]) for part in rows), timerValues)

    def step(self, fold: Promotion, values: tuple) -> None:
        candidate, score, incumbent = values
        fold.consider(candidate, score, incumbent if known(incumbent) else None)

    def packed(self, fold: Promotion) -> tuple:
        return (fold.active, fold.score, fold.pending, fold.streak, fold.changes)


PROMOTION = "active string, decided_score double, pending string, streak bigint, changes bigint"


def kept_promotions(evaluations: DataFrame, default: str, margin: float = 0.005, wins: int = 2, ttl_s: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Promotion state per corridor after each micro-batch of ``evaluations`` (corridor_id, at, candidate, score, incumbent_score).

    State lives in the store, only keys of the batch are touched. ``initial`` (corridor_id and the state's columns) is
    where corridors start; with ``ttl_s`` a state that isn't written for so long is forgotten. Update mode.
    """
    fold = KeptPromotion(default, margin, wins, ttl_s)
    rows = evaluations.where("corridor_id is not null and at is not null and candidate is not null").groupBy("corridor_id")
    begin = None if initial is None else initial.groupBy("corridor_id")
    return rows.transformWithStateInPandas(fold, f"corridor_id string, {PROMOTION}", "update", _clock(ttl_s), begin)


CONFORMAL = "offset_s double, step_size double, n bigint, missed bigint, w0 double, w1 double, w2 double, w3 double"


class KeptConformal(KeptFold):
    """The conformal offset of a key."""

    def __init__(self, target: float, remember: bool, order: Sequence[str], ttl_s: int | None):
        super().__init__(order, ["raw", "seen"], CONFORMAL, [f.split()[0] for f in CONFORMAL.split(", ")], ttl_s)
        self.target, self.remember = target, remember

    def start(self, kept: tuple | None) -> Conformal:
        fold = Conformal(self.target, self.remember)
        if kept is not None:
            fold.offset, fold.step_size, fold.n, fold.missed = kept[:4]
            fold.weights = list(kept[4:])
        return fold

    def moved(self, fold: Conformal, columns: list[list]) -> None:
        fold.update_all((raw, seen) for raw, seen in zip(*columns) if known(raw) and known(seen))

    def packed(self, fold: Conformal) -> tuple:
        return (float(fold.offset), float(fold.step_size), fold.n, fold.missed, *map(float, fold.weights))


def kept_conformal(observations: DataFrame, order: Sequence[str] = ("at",), target: float = 0.8, remember: bool = False, ttl_s: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Conformal state per key after each micro-batch of ``observations`` (key, ``order``, raw, seen); as ``kept_promotions`` else."""
    schema = T.StructType([T.StructField("key", observations.schema["key"].dataType), *T.StructType.fromDDL(CONFORMAL)])
    begin = None if initial is None else initial.groupBy("key")
    return observations.where("key is not null").groupBy("key").transformWithStateInPandas(KeptConformal(target, remember, order, ttl_s), schema, "update", _clock(ttl_s), begin)
