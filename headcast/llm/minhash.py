"""MinHash near-duplicates: bands propose, odd sketches estimate, full shingle sets decide.

Each different set of shingles is one node. Its ``SAMPLES`` MinHash values give 32 bands of 4, and all of them are folded
into a bitmap of parities, the odd sketch: of two sketches' exclusive or, samples in common cancel out. Sets alike by 0.8
miss each other in all bands with probability (1 - 0.8^4)^32 < 5e-8, and their sketches differ in 93 bits with a deviation of 12, in more
than ``FAR_BITS`` with probability below 1e-8; at 0.5 it is 200 bits. A second odd sketch takes every shingle for a sample: there no
more bits can differ than shingles, for sets alike by 0.8 a ninth of both sizes, which tells 0.78 from 0.8 in texts of some hundred
words; where that ninth is large, fewer bits are expected (some meet on one place), and six deviations more than expected rule a pair out.

Members of a band's bucket meet in three steps. Twice, two pivots of each bucket (least and largest by node, then by mixed node) meet
all others that aren't in their group yet, each going on only to the pivot with the nearest sketch; what the full sets confirm is
merged. So a group of near copies becomes one in a number of pairs that follows its size. Last, in buckets that still hold several
groups all members of different groups are compared by sketch, and those near enough by their sets: no pair that a band proposes is
left out, however crowded its bucket. Buckets of over ``block`` members are dealt out as pairs of blocks, so that no task holds a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import cut, ensure_checkpoint_dir
from headcast.llm.arrowmap import small_batches, with_document_columns
from headcast.llm.components import connected_components
from headcast.llm.simhash import UPPER_TO_LOWER, fingerprint

SAMPLES, BANDS, ROWS, SKETCH_BITS, FAR_BITS = 256, 32, 4, 1024, 160
#: No more rows than this are broadcast; beyond, Spark joins them by exchange.
FEW_ROWS = 1_000_000
#: Rows of documents to a part of the tables made from them.
PART_ROWS = 20_000
_RANDOM = np.random.Generator(np.random.PCG64(20_240))
FACTORS = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
MIX = [np.uint64(int(x) | 1) for x in _RANDOM.integers(1 << 62, 1 << 63, ROWS + 2, dtype=np.uint64)]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back: compressed, where ``cut`` isn't."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles; one shingle for a text of fewer words, none without words."""
    words = text.translate(UPPER_TO_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = len(words) - size + 1
    first, last, of = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[size - 1 :] - 1).tolist(), xxhash.xxh64_intdigest
    return np.unique(np.array([of(line[i:j]) for i, j in zip(first, last)], dtype=np.uint64))


def samples(hashes: np.ndarray, at_once: int = 512) -> np.ndarray:
    """MinHash values of a set: the least of its hashes under each of ``SAMPLES`` multiplications modulo 2 ** 32."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), at_once):
        np.minimum(least, (short[at : at + at_once, None] * FACTORS).min(axis=0), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per row of ``values`` and band."""
    parts = values[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[-1]
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * MIX[r]
        key = key ^ key >> np.uint64(29)
    return key.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parities of how many (sample number, value) fall on each of ``SKETCH_BITS`` places, as longs."""
    place = (values.astype(np.uint64) + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(33))) * MIX[-2]
    place = (place ^ place >> np.uint64(31)) * MIX[0] >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    flat = place.astype(np.int64) + np.arange(len(values), dtype=np.int64)[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=len(values) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), SKETCH_BITS), axis=1).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set."""
    place = (hashes ^ hashes >> np.uint64(32)) * MIX[1] >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


#: Bits that may differ between the whole sets' sketches of texts alike by 0.8, by the number of their shingles together.
ALLOWED_SQL = f"least(floor(({{0}} + {{1}}) / 9), {SKETCH_BITS / 2} * (1 - exp(-2 * floor(({{0}} + {{1}}) / 9) / {SKETCH_BITS})) + {3 * SKETCH_BITS**0.5})"
LONGS = SKETCH_BITS // 64


def allowed(sizes: np.ndarray) -> np.ndarray:
    """``ALLOWED_SQL`` for sums of sizes."""
    most = sizes // 9
    return np.minimum(most, SKETCH_BITS / 2 * (1 - np.exp(-2 * most / SKETCH_BITS)) + 3 * SKETCH_BITS**0.5)


def similar_sets(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 80 * (len(x) + len(y) - common)


def signed_texts(rows: DataFrame, keep: list[str], shingle: int, prints: int | None = None) -> DataFrame:
    """``keep``, ``node`` (hash of the text's set; null without words), ``size``, ``sketch`` (of the samples, then of the set) and ``bands`` of each row's text, and with
    ``prints`` the SimHash fingerprint ``fp`` of its set of so long shingles (else null)."""

    def work(texts: list[bytes | None]) -> list:
        nodes, sizes, place, values, whole, known = [], [], [], [], [], {}
        for t in texts:
            found = shingle_set(t, shingle)
            node = xxhash.xxh64_intdigest(found.tobytes()) if len(found) else None
            if node is not None and node not in known:
                known[node] = len(values)
                values.append(samples(found))
                whole.append(parities(found))
            nodes.append(None if node is None else node - (1 << 64) if node >> 63 else node)
            sizes.append(len(found))
            place.append(-1 if node is None else known[node])
        many = np.array(values, dtype=np.uint32).reshape(-1, SAMPLES)
        keys = band_keys(many)
        sketches = np.concatenate([odd_sketches(many), np.array(whole, dtype=np.int64).reshape(-1, LONGS)], axis=1)
        marks = [None if prints is None else fingerprint(t, prints, distinct=True) for t in texts]
        marks = [m if m is None or m < 1 << 63 else m - (1 << 64) for m in marks]
        return [nodes, marks, sizes, [None if p < 0 else sketches[p] for p in place], [None if p < 0 else keys[p] for p in place]]

    longs = T.ArrayType(T.LongType())
    return with_document_columns(rows, "text", keep, [("node", T.LongType()), ("fp", T.LongType()), ("size", T.LongType()), ("sketch", longs), ("bands", longs)], lambda: work, slice_rows=500)


def _ordered(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")


def star_pairs(shared: DataFrame, nodes: DataFrame, settled: DataFrame, mix: int) -> DataFrame:
    """For each node the pivot of its buckets with the nearest sketch, out of those of other groups that may be alike."""
    mixed = F.col("node").bitwiseXOR(F.lit(mix))
    rooted = shared.join(settled, "node")
    ends = rooted.groupBy("key").agg(F.min(mixed).alias("lo"), F.max(mixed).alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    met = rooted.join(ends, "key").select("node", "root", F.explode(F.array(F.col("lo").bitwiseXOR(F.lit(mix)), F.col("hi").bitwiseXOR(F.lit(mix)))).alias("pivot"))
    met = met.where("node <> pivot").distinct()
    other = nodes.select(F.col("node").alias("pivot"), F.col("size").alias("p_size"), F.col("sketch").alias("p_sketch"))
    met = met.join(settled.select(F.col("node").alias("pivot"), F.col("root").alias("p_root")), "pivot").where("root <> p_root").drop("root", "p_root")
    apart = F.zip_with("sketch", "p_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = lambda first: F.aggregate(F.slice(F.col("apart"), first, LONGS), F.lit(0), lambda n, x: n + x)
    near = met.join(nodes.select("node", "size", "sketch"), "node").join(other, "pivot").where("4 * size <= 5 * p_size and 4 * p_size <= 5 * size").select("node", "pivot", "size", "p_size", apart.alias("apart"))
    near = near.where((bits(1) <= FAR_BITS) & (bits(LONGS + 1) <= F.expr(ALLOWED_SQL.format("size", "p_size")))).select("node", "pivot", bits(1).alias("far"))
    nearest = near.groupBy("node").agg(F.min_by("pivot", "far").alias("pivot"))
    return _ordered(nearest, F.col("node"), F.col("pivot")).distinct()


def bucket_pairs(shared: DataFrame, nodes: DataFrame, settled: DataFrame, block: int = 4096) -> DataFrame:
    """All pairs of different groups that share a bucket and whose sizes and sketches don't rule them out."""
    rooted = shared.join(settled, "node")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1")
    members = rooted.join(mixed.select("key", "n"), "key")
    parts = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("node"), parts)
    beside = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    dealt = members.select("key", "node", "root", own.alias("own"), F.explode(beside).alias("tile")).select("key", "tile.lo", "tile.hi", "own", "node", "root")
    dealt = dealt.join(nodes.select("node", "size", "sketch"), "node").select("key", "lo", "hi", "own", "node", "root", "size", "sketch")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    small_batches(dealt)
    return dealt.mapInArrow(_tiles, "a long, b long").distinct()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each run of equal (key, lo, hi): between both blocks, or within one if lo = hi."""

    def near(run: list[np.ndarray], at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        lo, hi, own, node, root, size, sketch = run
        inside = lo[0] == hi[0]
        roots, part, members = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) < 2:
            return
        # all but the largest group's members meet everything; that group's own never meet
        big = part == members.argmax()
        order = np.argsort(big, kind="stable")
        node, root, size, sketch, own = (c[order] for c in (node, root, size, sketch, own))
        few, step = int((~big).sum()), max(1, at_once // len(node))
        for begin in range(0, few, step):
            i = np.arange(begin, min(begin + step, few))
            apart = np.bitwise_count(sketch[i][:, None, :] ^ sketch[None, begin:, :])
            j = np.arange(begin, len(node))
            good = (apart[:, :, :LONGS].sum(axis=2, dtype=np.int64) <= FAR_BITS) & (j[None, :] > i[:, None]) & (root[i][:, None] != root[None, begin:])
            good &= apart[:, :, LONGS:].sum(axis=2, dtype=np.int64) <= allowed(size[i][:, None] + size[None, begin:])
            good &= (4 * size[i][:, None] <= 5 * size[None, begin:]) & (4 * size[None, begin:] <= 5 * size[i][:, None])
            if not inside:
                good &= own[i][:, None] != own[None, begin:]
            x, y = np.nonzero(good)
            x, y = node[i[x]], node[j[y]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[:7]] + [batch.column(7).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)]
        columns = columns if held is None else [np.concatenate(c) for c in zip(held, columns)]
        key, lo, hi = columns[:3]
        change = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for b, e in zip(starts, starts[1:]):
            if e - b > 1:
                yield from near([c[b:e] for c in columns[1:]])
        held = [c[starts[-1] :] for c in columns]
    if held is not None:
        yield from near(held[1:])


def confirmed(pairs: DataFrame, rows: DataFrame, ones: DataFrame, shingle: int, parts: int) -> DataFrame:
    """Those of ``pairs`` (nodes a, b) whose full sets are alike by 0.8 or more. ``ones`` names a row of ``rows`` for each node."""
    pairs = cut(pairs.coalesce(parts))
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ones, "node").coalesce(parts))
    side = F.broadcast(needed) if needed.count() <= FEW_ROWS else needed
    on = F.col("row_id").eqNullSafe(F.col("one_id")) & (F.col("row_hash") == F.col("one_hash"))
    # rows that share id and text are one: any of them will do
    texts = stored(rows.join(side, on).select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"]).coalesce(parts))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def found(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 256:
                    known.clear()
                known[node] = shingle_set(text.as_py(), shingle)
            return known[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [similar_sets(found(i, x), found(j, y)) for i, j, x, y in zip(a, b, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    small_batches(both)
    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def merged(settled: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """``node`` and ``root`` after groups that ``links`` tie together have become one; only groups go through the components."""
    root = lambda side, name: settled.select(F.col("node").alias(side), F.col("root").alias(name))
    ends = links.join(root("a", "u"), "a").join(root("b", "v"), "b").select("u", "v").distinct()
    whole = connected_components(ends, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return cut(settled.join(whole, "root", "left").select("node", F.coalesce("whole", "root").alias("root")).coalesce(parts))


def linked_texts(rows: DataFrame, shingle: int, block: int = 4096, prints: int | None = None, proposals: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' nodes (row_id, row_hash, node, size; null without words), and ``root`` of each ``node``, equal for what links connect.

    ``rows``: row_id, row_hash, text. ``proposals``, if given, names further pairs (a, b) of nodes to begin with, from the nodes with
    their SimHash fingerprints ``fp`` of ``prints``-word shingle sets; they are confirmed like all others.
    """
    made = cut(signed_texts(rows, ["row_id", "row_hash"], shingle, prints))
    # equal sets fold into one node, ahead of the exchange; one row stands for it
    nodes = made.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min(F.struct("row_id", "row_hash")).alias("one"))
    # a small table in few parts: each part that writes to an exchange costs files, however little it holds
    parts = 1 + made.count() // PART_ROWS
    nodes = cut(nodes.coalesce(parts))
    ones = nodes.select("node", F.col("one.row_id").alias("one_id"), F.col("one.row_hash").alias("one_hash"))
    posted = nodes.select(F.explode("bands").alias("key"), "node")
    several = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = stored(posted.join(several, "key").coalesce(parts))
    settled = nodes.select("node", F.col("node").alias("root"))
    if proposals is not None:
        settled = merged(settled, confirmed(proposals(nodes), rows, ones, shingle, parts), parts)
    for mix in (0, 0x5DEECE66D1CE4E5B):
        settled = merged(settled, confirmed(star_pairs(shared, nodes, settled, mix), rows, ones, shingle, parts), parts)
    settled = merged(settled, confirmed(bucket_pairs(shared, nodes, settled, block), rows, ones, shingle, parts), parts)
    return made, settled


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, block: int = 4096) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked whose sets of ``shingle``-word shingles have 80 % or more of their union in common; a text of fewer words
    has its whole sequence as one shingle. ``component_id`` is the smallest id that links reach, itself included, null if no reachable row has
    one; a row is ``kept`` if it has that id (or both are null). Null and wordless texts have no shingles and are linked with nothing, not
    even each other. Rows with equal sets are linked, repeated rows give repeated rows, an empty table an empty one; other
    columns are dropped, so none can clash. Sets and texts are known by 64-bit hashes.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    made, settled = linked_texts(rows, shingle, block)
    least = made.where("node is not null").groupBy("node").agg(F.min("row_id").alias("least")).join(settled, "node").groupBy("root").agg(F.min("least").alias("component"))
    found = made.select("row_id", "size", "node").join(settled.join(least, "root").select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("row_id")).otherwise(F.col("component"))
    return found.select(F.col("row_id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("row_id").eqNullSafe(component).alias("kept"))
