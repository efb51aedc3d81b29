"""Order statistics over windows that slide along a key's history, from one sorted stream without an array per row.

Each left row asks about the right rows of its key whose time lies within a band around its own. Both sides are dealt by key and
stretch of time (a right row to the two stretches whose windows can reach it), sorted by when they matter, and streamed: a task
holds the values of one window, kept in order as rows enter and leave.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Values:
    """Numbers of a window, in order."""

    def __init__(self) -> None:
        self.held: deque = deque()
        self.order: list[float] = []

    def push(self, at: int, values: tuple) -> None:
        self.held.append((at, values[0]))
        if values[0] is not None:
            insort(self.order, values[0])

    def pop(self) -> None:
        _, value = self.held.popleft()
        if value is not None:
            del self.order[bisect_left(self.order, value)]


def quantile(order: Sequence[float], q: float) -> float:
    """Linear between neighbours; ``order`` isn't empty."""
    rank = (len(order) - 1) * q
    low = int(rank)
    high = min(low + 1, len(order) - 1)
    return order[low] + (rank - low) * (order[high] - order[low])


class Spread(Values):
    """Number of known values, and their interquartile range as a standard deviation (null below ``least`` values)."""

    schema = "n_recent int, volatility double"

    def __init__(self, least: int = 3) -> None:
        super().__init__()
        self.least = least

    def answer(self) -> tuple:
        n = len(self.order)
        return (n, abs(quantile(self.order, 0.75) - quantile(self.order, 0.25)) / 1.349 if n >= self.least else None)


class Departures:
    """Departures ahead: the first, how many gaps follow, their median, the first one, and the median of the others."""

    schema = "first_at bigint, first_near boolean, n_gaps int, gap double, first_gap double, rest double"

    def __init__(self) -> None:
        self.held: deque = deque()
        self.gaps: list[int] = []

    def push(self, at: int, values: tuple) -> None:
        if self.held:
            insort(self.gaps, at - self.held[-1][0])
        self.held.append((at, values[0]))

    def pop(self) -> None:
        at, _ = self.held.popleft()
        if self.held:
            del self.gaps[bisect_left(self.gaps, self.held[0][0] - at)]

    def answer(self) -> tuple:
        if not self.held:
            return (None, None, 0, None, None, None)
        at, near = self.held[0]
        n, median, first, rest = len(self.gaps), None, None, None
        if n:
            median = quantile(self.gaps, 0.5) / 1e6
            first = self.held[1][0] - at
        if n > 1:
            # the others' ranks are those of all with the first one's place passed over
            gone = bisect_left(self.gaps, first)
            other = lambda k: self.gaps[k + (k >= gone)]
            rest = (other((n - 2) // 2) + other((n - 1) // 2)) / 2 / 1e6
        return (at, near, n, median, None if first is None else first / 1e6, rest)


class Directions:
    """Rows of a window, and of each known direction (in lower case) the rows and the different runs."""

    schema = "n_seen bigint, by array<struct<direction: string, shown: string, n: bigint, runs: bigint>>"

    def __init__(self) -> None:
        self.held: deque = deque()
        self.by: dict[str, tuple[dict, dict]] = {}

    def _count(self, values: tuple, step: int) -> None:
        run, shown = values
        if shown is None:
            return
        names, runs = self.by.setdefault(shown.lower(), ({}, {}))
        for counts, key in ((names, shown), (runs, run)):
            counts[key] = counts.get(key, 0) + step
            if not counts[key]:
                del counts[key]

    def push(self, at: int, values: tuple) -> None:
        self.held.append((at, values))
        self._count(values, 1)

    def pop(self) -> None:
        self._count(self.held.popleft()[1], -1)

    def answer(self) -> tuple:
        rows = [(d, shown, n, sum(r is not None for r in runs)) for d, (names, runs) in sorted(self.by.items()) for shown, n in sorted(names.items())]
        return (len(self.held), [dict(zip(("direction", "shown", "n", "runs"), r)) for r in rows])


class Sightings:
    """Rows of a window, different values among them, and the time of the first."""

    schema = "n bigint, n_different bigint, first_us bigint"

    def __init__(self) -> None:
        self.held: deque = deque()
        self.counts: dict = {}

    def push(self, at: int, values: tuple) -> None:
        self.held.append((at, values[0]))
        if values[0] is not None:
            self.counts[values[0]] = self.counts.get(values[0], 0) + 1

    def pop(self) -> None:
        value = self.held.popleft()[1]
        if value is not None:
            self.counts[value] -= 1
            if not self.counts[value]:
                del self.counts[value]

    def answer(self) -> tuple:
        return (len(self.held), len(self.counts), self.held[0][0] if self.held else None)


class Marks(Sightings):
    """How many rows of a window have each of two marks, and the different values of a third column."""

    schema = "n_first bigint, n_second bigint, n_different bigint"

    def __init__(self) -> None:
        super().__init__()
        self.marks: deque = deque()
        self.n = [0, 0]

    def push(self, at: int, values: tuple) -> None:
        super().push(at, values[2:])
        self.marks.append((bool(values[0]), bool(values[1])))
        self.n = [n + m for n, m in zip(self.n, self.marks[-1])]

    def pop(self) -> None:
        super().pop()
        self.n = [n - m for n, m in zip(self.n, self.marks.popleft())]

    def answer(self) -> tuple:
        return (*self.n, len(self.counts))


class Mean:
    """Number and mean of a window's known values; what a sum's last bits lose is kept beside it, so that nothing drifts."""

    schema = "n bigint, mean double"

    def __init__(self) -> None:
        self.held: deque = deque()
        self.n, self.total, self.lost = 0, 0.0, 0.0

    def _add(self, value: float) -> None:
        total = self.total + value
        part = total - self.total
        self.lost += (self.total - (total - part)) + (value - part)
        self.total = total

    def push(self, at: int, values: tuple) -> None:
        self.held.append(values[0])
        if values[0] is not None:
            self.n += 1
            self._add(values[0])

    def pop(self) -> None:
        value = self.held.popleft()
        if value is not None:
            self.n -= 1
            self._add(-value)

    def answer(self) -> tuple:
        return (self.n, (self.total + self.lost) / self.n if self.n else None)


class Coming:
    """Of the predictions of a window those for the ``horizon`` seconds from now on: of one time the newest counts.

    Values: predicted time (microseconds), approaching, run. Gives the ``first`` ones, the number, and the upper median, the
    quartile range (below four gaps: of all) and the least of the gaps.
    """

    timed = True

    def __init__(self, horizon: float, first: int, run: str) -> None:
        self.schema = f"coming array<struct<arrives: double, approaching: boolean, run: {run}>>, n_coming int, headway_median_s double, headway_iqr_s double, headway_min_s double"
        self.horizon, self.first = horizon, first
        self.held: deque = deque()
        self.times: list[int] = []
        self.by: dict[int, deque] = {}

    def push(self, at: int, values: tuple) -> None:
        when = values[0]
        self.held.append(when)
        if when is None:
            return
        told = self.by.get(when)
        if told is None:
            told = self.by[when] = deque()
            insort(self.times, when)
        told.append(values[1:])

    def pop(self) -> None:
        when = self.held.popleft()
        if when is None:
            return
        told = self.by[when]
        told.popleft()
        if not told:
            del self.by[when]
            del self.times[bisect_left(self.times, when)]

    def answer(self, now: int | None) -> tuple:
        if now is None:
            return (None, 0, None, None, None)
        low, high = bisect_left(self.times, now), bisect_right(self.times, now + round(self.horizon * 1e6))
        if low == high:
            return (None, 0, None, None, None)
        # seconds as doubles, as the differences of the tables' times are taken everywhere
        ahead = np.array(self.times[low:high], dtype=np.float64) / 1e6 - now / 1e6
        gaps = np.sort(np.diff(ahead))
        m = len(gaps)
        near = [{"arrives": float(t), "approaching": told[0], "run": told[1]} for t, told in ((ahead[i], self.by[self.times[low + i]][-1]) for i in range(min(self.first, high - low)))]
        if not m:
            return (near, 1, None, None, None)
        spread = gaps[m * 3 // 4] - gaps[m // 4] if m >= 4 else gaps[-1] - gaps[0]
        return (near, m + 1, float(gaps[m // 2]), float(spread), float(gaps[0]))


def over_windows(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: Column, at_right: Column, low: int, high: int, make: Callable[[], Any], values: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``left`` with what ``make()`` answers for the right rows with ``low <= at_right - at_left <= high`` (microseconds).

    ``make()`` has ``schema``, ``push(at, values)``, ``pop()`` of the oldest, and ``answer()``, or with ``timed`` ``answer(now)``, the
    time of the left row (null for one without key or time). Right rows of one time come by
    ``order``. Left rows with a null key or time meet an empty window; right rows with one are left out.
    """
    keys, width = list(keys), max(1, high - low)
    item = [c for c in dict.fromkeys([*order, *values])]
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    coming = right.where(some & at_right.isNotNull()).select(*keys, at_right.alias("__t"), F.struct(*[F.col(c) for c in item]).alias("__item"))
    stretch = F.floor(F.col("__t") / width)
    coming = coming.withColumn("__bin", F.explode(F.array(stretch, stretch - 1))).withColumn("__own", F.lit(False))
    row = F.struct(*left.columns)
    # a question is asked when the last row of its window has come
    asked = left.select(*keys, F.when(some, at_left + high).alias("__t"), F.floor((at_left + low) / width).alias("__bin"), row.alias("__row"), F.lit(True).alias("__own"))
    both = coming.unionByName(asked, allowMissingColumns=True).select(*keys, "__bin", "__t", "__own", "__item", "__row")
    dealt = both.repartition(*keys, "__bin").sortWithinPartitions(*keys, "__bin", "__t", "__own", *[f"__item.{c}" for c in order])
    fields = T.StructType.fromDDL(make().schema)
    out = T.StructType([T.StructField("__row", both.schema["__row"].dataType), *fields])
    types, n_keys, span, use, timed = [to_arrow_type(f.dataType) for f in fields], len(keys) + 1, width, list(values), getattr(make(), "timed", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, held = None, make(), deque()
        for batch in batches:
            group = list(zip(*[c.to_pylist() for c in batch.columns[:n_keys]]))
            at, own = batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist()
            items = [batch.column(n_keys + 2).field(c).to_pylist() for c in use]
            rows, answers = [], []
            for i, now in enumerate(group):
                if now != key:
                    key, window, held = now, make(), deque()
                if not own[i]:
                    window.push(at[i], tuple(c[i] for c in items))
                    held.append(at[i])
                    continue
                while at[i] is not None and held and held[0] < at[i] - span:
                    window.pop()
                    held.popleft()
                rows.append(i)
                if timed:
                    answers.append(window.answer(None if at[i] is None else at[i] - high))
                else:
                    answers.append(window.answer() if at[i] is not None else make().answer())
            if rows:
                taken = batch.column(n_keys + 3).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken, *[pa.array(c, t) for c, t in zip(zip(*answers), types)]], names=["__row", *fields.names])

    return dealt.mapInArrow(run, out).select("__row.*", *fields.names)
