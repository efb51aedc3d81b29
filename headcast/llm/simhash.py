"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

Each of the 64 places of a fingerprint gets a nonzero vector of radius + 1 bits. Every nonzero vector v of that size
gives one table, whose mask keeps the places with odd parity against v. At most ``radius`` differing places span less
than the whole space, so some v is orthogonal to all of them, and in that table both fingerprints have the same key: no
pair within the radius is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import cut
from headcast.llm.arrowmap import with_document_columns
from headcast.llm.components import connected_components

BITS = 64
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42, distinct: bool = False, at_once: int = 1 << 16) -> int:
    """Unsigned fingerprint of the ``shingle``-word shingles, each once if ``distinct``, else repeats included; 0 without words."""
    words = text.translate(UPPER_TO_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    n = len(words) - size + 1
    first, last, of = begins[:n].tolist(), (ends[size - 1 :] - 1).tolist(), xxhash.xxh64_intdigest
    every = np.array([of(line[i:j], seed) for i, j in zip(first, last)], dtype="<u8")
    every = np.unique(every) if distinct else every
    n, ones = len(every), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, at_once):
        hashes = every[at : at + at_once]
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = 4, distinct: bool = False) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long. Null and wordless texts get zero."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle, distinct=distinct) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

    return with_document_columns(df, text_col, keep, [("fp", T.LongType())], make)


def covering_masks(radius: int) -> list[int]:
    """One mask per table: 2 ** (radius + 1) - 1 of them, none with much under half of the places.

    Any vectors give the guarantee; few places in a mask would give long runs of equal keys. Up to radius 5 all
    vectors are dealt out in turn. Beyond there are more vectors than places: those with the top bit set are taken,
    spaced evenly, for which masks hold half of the places (a first-order Reed-Muller code at radius 6).
    """
    size = radius + 1
    vectors = (1 << size) - 1
    if vectors < BITS:
        place = [i % vectors + 1 for i in range(BITS)]
    else:
        top = 1 << (size - 1)
        place = [top | (i * (top // BITS) + (i * 7 % BITS) * (top // BITS > 1)) % top for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (place[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


EDGE = "a long, b long, crowded boolean"


def link(prints: DataFrame, radius: int = 4, fp_col: str = "fp", crowd: int = 32_768) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what pairs of different fingerprints within ``radius`` bits connect.

    ``prints`` holds each fingerprint once. Table keys are dealt out and sorted; a task walks the runs of equal keys
    and emits a spanning forest of each run's links (each of them within the radius), never all pairs. A run of over ``crowd`` fingerprints isn't
    compared: its members go the exact other way, where each emits all fingerprints within half the radius of itself,
    and those that share one of these are within the radius of each other. That costs a fixed number of rows per
    fingerprint however large the crowd, and its groups are streamed.
    """
    if radius % 2:
        raise ValueError("the radius must be even: crowded keys meet halfway")
    masks = covering_masks(radius)
    fp = F.col(fp_col)
    keys = F.array(*[F.xxhash64(F.lit(v), fp.bitwiseAND(F.lit(signed(m)))) for v, m in enumerate(masks)])
    dealt = prints.where(fp.isNotNull()).select(fp.alias("fp"), F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", "fp")
    # many tables find the same link: it is written once
    found = cut(dealt.mapInArrow(_walk(radius, crowd), EDGE).distinct())
    halfway = np.array([sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)], dtype=np.uint64)
    crowded = found.where("crowded").select(F.col("a").alias("fp")).distinct()
    met = crowded.mapInArrow(_spread(halfway), "fp long, key long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_chain, "a long, b long")
    return found.where("not crowded").select("a", "b").unionByName(met).distinct()


def _walk(radius: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, dtype=np.uint64)
        crowded_key = None
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            keys = batch.column(1).to_numpy()
            if not len(keys):
                continue
            if held_key is not None:
                prints, keys = np.concatenate([held, prints]), np.concatenate([np.full(len(held), held_key), keys])
            edges: list[np.ndarray] = []
            if crowded_key is not None:
                same = int(np.searchsorted(keys, crowded_key, side="right"))
                edges.append(np.stack([prints[:same], prints[:same], np.ones(same, np.uint64)], axis=1))
                prints, keys = prints[same:], keys[same:]
                if not len(keys):
                    yield _edges(edges)
                    continue
                crowded_key = None
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            begin = int(starts[-1])
            edges += _links(prints[:begin], np.append(starts[:-1], begin), radius, crowd)
            held_key, held = int(keys[-1]), prints[begin:]
            if len(held) > crowd:
                edges.append(np.stack([held, held, np.ones(len(held), np.uint64)], axis=1))
                crowded_key, held_key, held = held_key, None, held[:0]
            yield _edges(edges)
        if held_key is not None:
            yield _edges(_links(held, np.array([0, len(held)]), radius, crowd))

    return run


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(parts) if parts else np.empty((0, 3), dtype=np.uint64)
    a, b = np.ascontiguousarray(rows[:, 0]).view(np.int64), np.ascontiguousarray(rows[:, 1]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(rows[:, 2] != 0)], names=["a", "b", "crowded"])


def _links(prints: np.ndarray, bounds: np.ndarray, radius: int, crowd: int) -> list[np.ndarray]:
    """Edges of the runs between ``bounds``: short ones by shifted comparison of all at once, others one by one."""
    sizes = np.diff(bounds)
    out = []
    short = np.repeat(np.where(sizes <= 8, sizes, 0), sizes)
    place = np.arange(len(prints)) - np.repeat(bounds[:-1], sizes)
    for lag in range(1, 8):
        at = np.flatnonzero(place + lag < short)
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= radius]
        out.append(np.stack([prints[near], prints[near + lag], np.zeros(len(near), np.uint64)], axis=1))
    for run in np.flatnonzero(sizes > 8):
        members = prints[bounds[run] : bounds[run + 1]]
        if len(members) > crowd:
            out.append(np.stack([members, members, np.ones(len(members), np.uint64)], axis=1))
            continue
        left = members
        while len(left):
            left, queue = left[1:], [left[0]]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(left ^ at) <= radius
                if near.any():
                    reached = left[near]
                    out.append(np.stack([np.full(len(reached), at), reached, np.zeros(len(reached), np.uint64)], axis=1))
                    left = left[~near]
                    queue.extend(reached)
    return out


def _spread(halfway: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), 64):
                some = prints[at : at + 64]
                keys = (some[:, None] ^ halfway[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(halfway)).view(np.int64)), pa.array(keys)], names=["fp", "key"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties each fingerprint of a run of equal keys to the one before it."""
    last_key = last_print = None
    for batch in batches:
        prints, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if last_key is not None:
            prints, keys = np.concatenate([[last_print], prints]), np.concatenate([[last_key], keys])
        same = keys[1:] == keys[:-1]
        last_key, last_print = keys[-1], prints[-1]
        yield pa.RecordBatch.from_arrays([pa.array(prints[1:][same]), pa.array(prints[:-1][same])], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, distinct: bool = False, crowd: int = 32_768) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id among all rows that chains of fingerprints within ``radius`` bits reach, itself
    included; it is null only if no reachable row has an id. Copies share a fingerprint and are linked through it, so a
    group of copies costs one fingerprint however large it is. Null and wordless texts have fingerprint zero and are
    linked like any other. Repeated rows give repeated rows, an empty table an empty one; other columns are dropped.
    """
    prints = cut(add_fingerprints(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", ["id"], shingle, distinct))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(link(classes.select("fp"), radius, crowd=crowd)).select(F.col("node").alias("fp"), "root")
    rooted = cut(classes.join(parts, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # minima are aggregated ahead of the exchange; the join that hands them back carries narrow rows, split if a root is hot
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
