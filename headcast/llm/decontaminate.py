"""Benchmark passages in training documents: a broadcast set of item n-grams, scanned over token windows and verified."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import cut
from headcast.llm.arrowmap import small_batches

#: Bytes of words: digits, letters (A-Z lowered) and all that isn't ASCII; any other byte separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text that isn't lowered.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SEED = 20_011


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """All windows of a block of items, by their length: hashes to find candidates, word ids to verify them."""

    def __init__(self, items: Sequence[tuple[str | None, bytes | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self.of: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            size = min(n, len(words))
            if not size:
                continue
            at = self.of.setdefault(size, {})
            for i in range(len(words) - size + 1):
                at.setdefault(tuple(words[i : i + size]), set()).add(len(self.items))
            self.items.append(item)
        factors = np.random.default_rng(SEED).integers(1, 1 << 62, size=n, dtype=np.uint64) | np.uint64(1)
        self.tables = []
        for size, windows in sorted(self.of.items()):
            rows = np.array(list(windows), dtype=np.uint64).reshape(-1, size)
            self.tables.append((size, factors[:size], np.unique((rows * factors[:size]).sum(axis=1, dtype=np.uint64)), windows))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the items (by place) that such windows belong to."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        hit, found = np.zeros(len(words), dtype=bool), set()
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, factors, hashes, windows in self.tables:
            if len(words) < size or known[-1] < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            sums = np.zeros(len(starts), dtype=np.uint64)
            for k in range(size):
                sums += ids[starts + k].astype(np.uint64) * factors[k]
            at = np.searchsorted(hashes, sums)
            for start in starts[hashes[np.minimum(at, len(hashes) - 1)] == sums].tolist():
                items = windows.get(tuple(ids[start : start + size].tolist()))
                if items:
                    hit[start : start + size] = True
                    found |= items
        return hit, found


def ranges_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def mark_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Words of each document that lie in a window of ``n`` words of a benchmark item (shorter items: the whole item).

    Adds ``n_words`` (long), ``hits`` (array of word ranges, end exclusive) and ``items`` (sorted array of item ids as
    strings). Null texts, items without words and null item ids: no words, no window, a window that hits but isn't
    listed. Repeated items count once. Columns outside ``keep`` are dropped.

    The benchmark's text is measured first. Up to ``block_bytes`` it is broadcast whole; beyond that it is dealt into
    blocks of about that size by a hash of the item, and the documents are scanned once per block, each pass adding to
    the ranges of the one before, so memory stays bounded and no hit is lost.
    """
    small_batches(df)
    spark = df.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = {"n_words", "hits", "items"}
    kept = [c for c in dict.fromkeys(keep) if c not in names]
    # a text that is carried along anyway is read from its own column rather than sent twice
    carried = text_col in kept and isinstance(df.schema[text_col].dataType, T.StringType)
    text = text_col if carried else "__headcast_text"
    extra = [] if carried else [F.col(f"`{text_col}`").cast("string").cast("binary").alias(text)]
    now = df.select(*[F.col(f"`{c}`") for c in kept], *extra, F.lit(None).cast(HITS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    fields = [now.schema[c] for c in kept] + ([] if carried else [T.StructField(text, T.BinaryType())]) + [T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]
    for block in range(blocks):
        last = block == blocks - 1
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)).collect()
        shared = spark.sparkContext.broadcast([(r.item, None if r.text is None else bytes(r.text)) for r in sorted(rows, key=lambda r: (r.item or "", r.text or b""))])
        out = [f for f in fields if not (last and f.name == "__headcast_text")]
        now = now.mapInArrow(_scan_with(shared, n, text, [f.name for f in out], blocks == 1), T.StructType(out))
        if not last:
            now = cut(now).drop("n_words")
    return now


def _scan_with(shared, n: int, text_col: str, names: list[str], fresh: bool, slice_rows: int = 2000):
    hits_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, n)
        for batch in (whole.slice(at, slice_rows) for whole in batches for at in range(0, whole.num_rows, slice_rows)):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            before = [None] * len(texts) if fresh else batch.column("hits").to_pylist()
            listed = [None] * len(texts) if fresh else batch.column("items").to_pylist()
            hits, items, counts = [], [], []
            for text, old, seen in zip(texts, before, listed):
                words = words_of(text)
                hit, found = windows.scan(words)
                for r in old or ():
                    hit[r["first"] : r["end"]] = True
                hits.append([{"first": a, "end": b} for a, b in ranges_of(hit)])
                items.append(sorted({*(seen or ()), *(windows.items[i] for i in found if windows.items[i] is not None)}))
                counts.append(len(words))
            made = {"hits": pa.array(hits, hits_type), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    return run


def contamination_report(marked: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Digest of ``mark_contamination``: hit words, items and a hash of their ids per document."""
    return marked.select(
        *keep,
        "n_words",
        F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["first"])), F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_spans(df: DataFrame, text_col: str = "text", hits_col: str = "hits") -> DataFrame:
    """``df`` with the hit word ranges cut out of ``text_col`` (a space stays in their place); ``hits_col`` is dropped."""
    names = [c for c in df.columns if c != hits_col]
    schema = T.StructType([df.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, ranges in enumerate(batch.column(hits_col).to_pylist()):
                if ranges and texts[i]:
                    texts[i] = cut_words(texts[i].encode("utf-8"), [(r["first"], r["end"]) for r in ranges]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def cut_words(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for first, end in ranges:
        out.append(data[at : places[first][0]])
        at = places[end - 1][1]
    return b" ".join([*(p.strip(b" ") if i else p.rstrip(b" ") for i, p in enumerate(out)), data[at:].lstrip(b" ")]) if ranges else data
