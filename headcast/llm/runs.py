"""Periodic runs of words, from a dictionary of basic factors, and texts with their repetitions collapsed.

For each power of two L, factors of L words are named so that equal factors have equal names (a name of 2 L is the pair of
names of its halves). A factor's successor is the next place in the text with its name. Places i, i + d, i + 2 d that follow
each other so, with d at most 2 L, are an arithmetic progression and propose period d at i. A run of period q and 4 q words or more
holds such a progression at the smallest L that isn't below q: the factor at its start recurs at distance q and at none below (its root
would be a power otherwise). Proposals are extended to both sides by the names, longest first, and equal results are dropped.

Texts go through together: words are known by text and word, and a mark of its own stands behind each text, so neither
factors nor runs reach from one into the next. Places whose factor occurs once drop out of all longer lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.llm.arrowmap import small_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period), sorted, of all maximal runs in ``ids``, with period the smallest and length >= max(least, periods * period).

    ``periods`` must be 4 or more. Numbers that occur once (marks between texts) end every run.
    """
    if periods < 4:
        raise ValueError("a run must hold its period four times or more")
    n = len(ids)
    empty = np.empty((0, 3), dtype=np.int64)
    if n < periods:
        return empty
    _, names = np.unique(ids, return_inverse=True)
    levels, proposed, length = [], [], 1
    names = names.astype(np.int64)
    live = np.arange(n)
    while True:
        # places of equal names, in order: each one's successor is the next in its group
        order = live[np.argsort(names[live], kind="stable")]
        same = names[order[1:]] == names[order[:-1]]
        after = np.full(n + 1, n, dtype=np.int64)
        after[order[:-1][same]] = order[1:][same]
        lone = np.ones(len(order), dtype=bool)
        lone[1:] &= ~same
        lone[:-1] &= ~same
        levels.append(names)
        gap = after[:n] - np.arange(n)
        close = live[(after[live] < n) & (gap[live] <= 2 * length)]
        third = close[(gap[np.minimum(close + gap[close], n - 1)] == gap[close]) & (close + gap[close] < n)]
        if len(third):
            # of neighbouring places with one distance the first will do: all extend to the same run
            first = np.ones(len(third), dtype=bool)
            first[1:] = (third[1:] != third[:-1] + 1) | (gap[third[1:]] != gap[third[:-1]])
            proposed.append(np.stack([third[first], gap[third[first]]], axis=1))
        live = np.sort(order[~lone])
        live = live[live + 2 * length <= n]
        if len(live) < 2:
            break
        # the next length: pairs of names, a place of its own for whatever occurs once
        wide = np.int64(n + 1)
        code = names[live] * wide + names[live + length]
        _, short = np.unique(code, return_inverse=True)
        names = n + np.arange(n, dtype=np.int64)
        names[live] = short
        # numbers are made dense again so that products stay in range
        _, dense = np.unique(names, return_inverse=True)
        names, length = dense.astype(np.int64), 2 * length
    if not proposed:
        return empty
    at, period = np.concatenate(proposed).T
    ahead, back = _common(levels, at, at + period, n), _common_back(levels, at, at + period)
    start, size = at - back, ahead + back + period
    keep = size >= np.maximum(least, periods * period)
    return np.unique(np.stack([start, size, period], axis=1)[keep], axis=0)


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Words that are equal from ``i`` and ``j`` (i < j) on. Names step down from the longest; the longest may step repeatedly."""
    done = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, names, moving = 1 << k, levels[k], np.arange(len(i))
        while len(moving):
            a, b = i[moving] + done[moving], j[moving] + done[moving]
            fits = b + size <= n
            equal = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
            moving = moving[equal]
            done[moving] += size
            if k < len(levels) - 1:
                break
    return done


def _common_back(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that are equal before ``i`` and ``j``, likewise."""
    done = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, names, moving = 1 << k, levels[k], np.arange(len(i))
        while len(moving):
            a, b = i[moving] - done[moving] - size, j[moving] - done[moving] - size
            fits = a >= 0
            equal = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
            moving = moving[equal]
            done[moving] += size
            if k < len(levels) - 1:
                break
    return done


def repeated_tail(n: int, h: int | None) -> np.ndarray | None:
    """Which original word stands at each place if ``h`` asks for a periodic tail; None if it doesn't."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def analyse(texts: Sequence[bytes | None], tails: Sequence[int | None]) -> list[tuple]:
    """For each text its runs' number, the longest's start, length, period and exponent, and both hashes."""
    all_words, codes, begins, total = [], [], [], 0
    for k, (text, h) in enumerate(zip(texts, tails)):
        words = text.split() if text else []
        moved = repeated_tail(len(words), h)
        if moved is not None:
            words = [words[i] for i in moved.tolist()]
        own: dict[bytes, int] = {}
        codes.append(np.array([own.setdefault(w, len(own)) for w in words], dtype=np.int64) + total)
        # numbers up to here are this text's, the next one is its end mark
        codes.append(np.array([total + len(words)], dtype=np.int64))
        all_words.append(words)
        begins.append(total)
        total += len(words) + 1
    found = find_runs(np.concatenate(codes)) if codes else np.empty((0, 3), dtype=np.int64)
    bounds = np.searchsorted(found[:, 0], [*begins, total])
    out = []
    for k, (words, begin) in enumerate(zip(all_words, begins)):
        runs = found[bounds[k] : bounds[k + 1]] - [begin, 0, 0]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist())
        best: tuple = (None, None, None, None)
        if len(runs):
            s, m, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
            best = (s, m, q, 1000 * m // q)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        out.append((len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), b" ".join(words)))
    return out


def find_periodic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: Column | None = None, keep_text: bool = False, words_at_once: int = 200_000) -> DataFrame:
    """One row per input row: the id, ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``; ties: the
    smallest start, then period; nulls without a run), ``runs_sha256`` and ``collapsed_sha256``, and with ``keep_text`` the ``collapsed`` text.

    ``tail``, if given, is a number per row that may ask for a periodic tail (``repeated_tail``). Null and wordless texts
    have no runs and collapse to nothing. Repeated rows give repeated rows, an empty table an empty one; other columns are
    dropped, so none can clash. About ``words_at_once`` words are worked on together, but a text is never split.
    """
    small_batches(df)
    mark = (tail if tail is not None else F.lit(None)).cast("long")
    inner = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), mark.alias("tail"))
    kind = inner.schema["id"].dataType
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["collapsed"] if keep_text else [])]
    types = [T.LongType()] * 5 + [T.StringType()] * 2 + [T.StringType()] * keep_text
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in zip(names, types)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tails = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            # every word takes two bytes or more, its space included
            sizes, begin = np.cumsum([len(t or b"") // 2 + 1 for t in texts]), 0
            while begin < len(texts):
                done = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + 3 * words_at_once, side="right")))
                rows = analyse(texts[begin:end], tails[begin:end])
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                columns += [pa.array([r[5] for r in rows]), pa.array([hashlib.sha256(r[6]).hexdigest() for r in rows])]
                columns += [pa.array([r[6].decode() for r in rows])] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *columns], names=["id", *names])
                begin = end

    return inner.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def id_tail(id_col: str = "doc_id") -> Column:
    """crc32 of the decimal id: the number that asks for a periodic tail."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
