"""Word-pair scoring with a weighted backoff automaton, part of it broadcast and the rest sharded over the cluster.

The model: p(w | v) = (c(vw) + mass * p(w)) / (c(v) + mass), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), from all words and
pairs of the training texts, those seen once too. As an automaton its states are words; a seen pair is an arc that
carries the pair's log-probability; a state's failure arc leads to the start and carries log(mass / (c(v) + mass)); the
start's arcs carry log p(w). The state after a word is that word, so a text is traversed as one vectorised step over
its (state, word) places.

Words with at least a share ``1 / words_bound`` of all tokens, and pairs with at least ``1 / pairs_bound`` (both at most
so many, whatever the data), are broadcast. A place whose arc isn't there takes the failure arc, and is also sent to
the shard of its pair (or of its word, if that isn't broadcast), packed into parcels: there all occurrences of the pair meet,
training ones are counted, and what the arc adds is handed back to the text. So the model grows with the corpus, no group in a shard holds
more than the stated shares of all tokens, and the bounds change where something is looked up, never a score.

Parcels are made for the disk. A bit map of the hashes of the words without a state is broadcast too: what isn't on it was
never learnt, so neither the word nor a pair with it goes anywhere. A shard is a range of contexts (several shards share a
frequent one) or of hashes, so that a parcel's keys, sorted, lie close together and travel as their steps.

``apart`` scores each learnt text a second time, under the counts without its own words and pairs (V stays): where a count is
looked up, the text's own share of it is taken off. So all texts are learnt from, and none has to vouch for itself.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import cut
from headcast.llm.arrowmap import small_batches

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end token's key: no word holds a space.
END = b" end"
ADDED = 0.1


def tokens_of(text: bytes | None) -> list[bytes]:
    words = text.translate(UPPER_TO_LOWER).split() if text else []
    words.append(END)
    return words


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null ids give null."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(by))


#: Bits of a word's id: no more words than that have a state.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> memoryview:
    return memoryview(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte of all of them: equal high bytes then lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def pair_steps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted codes: the step from each context to the next, and of each word from the one before with the same context."""
    context, word = codes >> np.uint64(ID_BITS), codes & np.uint64(ID_MASK)
    step = np.diff(context, prepend=np.uint64(0))
    return step, np.where((step == 0) & (np.arange(len(codes)) > 0), np.diff(word, prepend=np.uint64(0)), word)


def from_pair_steps(step: np.ndarray, word: np.ndarray) -> np.ndarray:
    begins = step != 0
    begins[:1] = True
    upto, first = np.cumsum(word), np.flatnonzero(begins)
    return np.cumsum(step) << np.uint64(ID_BITS) | (upto - (upto[first] - word[first])[np.cumsum(begins) - 1])


def merged_parcels(parcels: DataFrame, merge: Callable[[list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """``merge`` of all the parcels of each shard; ``parcels``: shard, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != shard and held:
                    yield merge(held)
                    held = []
                shard = k
                held.append(data)
        if held:
            yield merge(held)

    return parcels.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _batch(parcels: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parcels], pa.int32()), pa.array([p for _, p in parcels], pa.binary())], names=["shard", "data"])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_words(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """``word`` (binary, the end token too) and ``n``. Tasks count ahead of the exchange and hand on at ``flush`` words."""
    parts = _parts(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            dealt: dict[int, list[bytes]] = {}
            for word in sorted(counts):
                dealt.setdefault(zlib.crc32(word) % parts, []).append(word)
            # no word holds a line feed
            return _batch([(k, squeezed(len(words).to_bytes(8, "little") + planes(np.array([counts[w] for w in words]), 8) + b"\n".join(words))) for k, words in dealt.items()])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > flush:
                    yield out()
                    counts = Counter()
        yield out()

    def merge(parcels: list[bytes]) -> pa.RecordBatch:
        counts: Counter = Counter()
        for view in map(unsqueezed, parcels):
            n = int.from_bytes(view[:8], "little")
            for word, k in zip(bytes(view[8 + 8 * n :]).split(b"\n"), from_planes(view[8:], n, 8).tolist()):
                counts[word] += k
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return merged_parcels(texts.mapInArrow(run, "shard int, data binary"), merge, "word binary, n long")


def count_pairs(texts: DataFrame, shared, least: int, flush: int = 1 << 20) -> DataFrame:
    """``code`` (word << ID_BITS | next word) and ``n`` of the pairs of the words in ``shared`` (word to id) that occur ``least`` times."""
    parts = _parts(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, size = shared.value.get, [], 0

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held).astype(np.uint64), return_counts=True)
            shard = (mixed(codes, np.full(len(codes), 17, dtype=np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            codes, n, bounds = codes[order], n[order], np.searchsorted(shard[order], np.arange(parts + 1))
            cuts = [(k, slice(bounds[k], bounds[k + 1])) for k in range(parts) if bounds[k + 1] > bounds[k]]
            return _batch([(k, squeezed(b"".join([planes(n[at], 8), *(planes(c, 3) for c in pair_steps(codes[at]))]))) for k, at in cuts])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([get(w, -1) for w in tokens_of(text)], dtype=np.int64)
                both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                held.append(ids[:-1][both] << ID_BITS | ids[1:][both])
                size += len(held[-1])
                if size > flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(parcels: list[bytes]) -> pa.RecordBatch:
        codes, counts = [], []
        for view in map(unsqueezed, parcels):
            n = len(view) // 14
            counts.append(from_planes(view, n, 8))
            codes.append(from_pair_steps(from_planes(view[8 * n :], n, 3), from_planes(view[11 * n :], n, 3)))
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code[n >= least].astype(np.int64)), pa.array(n[n >= least])], names=["code", "n"])

    return merged_parcels(texts.mapInArrow(run, "shard int, data binary"), merge, "code long, n long")


@dataclass(frozen=True)
class Tables:
    """The broadcast part: frequent words with counts, most frequent first, frequent pairs with counts (sorted codes), N, V, the
    mass, and the bit map of the other words learnt."""

    key: str
    words: list[bytes]
    counts: np.ndarray
    codes: np.ndarray
    pairs: np.ndarray
    total: int
    distinct: int
    mass: float
    seen: np.ndarray

    @property
    def norm(self) -> float:
        return self.total + ADDED * (self.distinct + 1)


#: Where in a word's hash the places of its bits begin; the bit map has at most ``2 ** MAP_BITS`` bits (16 MB).
SHIFTS = (0, 18, 37)
MAP_BITS = 27
SEED = 42  # of Spark's xxhash64


def seen_map(words: DataFrame, n: int) -> np.ndarray:
    """A bit map of ``n`` words, about twelve bits a word: fewer past 11 million words, which lets more places travel for nothing."""
    if not n:
        return np.zeros(0, dtype=np.uint8)
    size = 1 << min(max((12 * n - 1).bit_length(), 15), MAP_BITS)
    h = F.xxhash64("word")
    at = words.select(F.explode(F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS])).alias("at"))
    dealt = at.select(F.shiftright("at", 15).cast("int").alias("block"), F.col("at").bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).repartition("block")
    blocks = dealt.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros((size >> 15, 1 << 12), dtype=np.uint8)
    for block, bits in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist()):
        out[block] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def train_tables(texts: DataFrame, words_bound: int = 1_000_000, pairs_bound: int = 50_000, mass: float = 40.0, most_words: int = 1_000_000) -> Tables:
    """Counts of all words, of which the frequent are kept here (at most ``most_words``), and of the frequent pairs among these."""
    words = cut(count_words(texts))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = max(1, -(-total // words_bound))
    kept, rare_from = 0, floor
    for n, some in sorted(((r[0], r[1]) for r in words.where(F.col("n") >= floor).groupBy("n").count().collect()), reverse=True):
        kept += some
        if kept > min(most_words, 1 << ID_BITS):
            kept, rare_from = kept - some, n + 1
            break
    frequent = words.where(F.col("n") >= rare_from).toArrow()
    known = sorted(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    seen = seen_map(words.where(F.col("n") < rare_from), distinct - kept)
    # what occurs once or twice isn't worth an arc everywhere
    least = max(3, -(-total // pairs_bound))
    ids = {w: i for i, (w, n) in enumerate(known) if n >= least}
    shared = texts.sparkSession.sparkContext.broadcast(ids)
    found = count_pairs(texts, shared, least).toArrow()
    shared.unpersist()
    codes, pairs = found.column("code").to_numpy(), found.column("n").to_numpy()
    by = np.argsort(codes)
    return Tables(uuid.uuid4().hex, [w for w, _ in known], np.array([n for _, n in known], dtype=np.int64), codes[by], pairs[by], total, distinct, mass, seen)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of 64-bit hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Automaton:
    """The broadcast states and arcs. Words without a state get their share of the score from their shard."""

    def __init__(self, tables: Tables):
        self.ids = {w: i for i, w in enumerate(tables.words)}
        n, mass = tables.counts, tables.mass
        self.counts, self.pairs, self.mass, self.norm = n, tables.pairs, mass, tables.norm
        self.log_mass = math.log10(mass)
        self.root = np.log10((n + ADDED) / tables.norm)
        self.left = -np.log10(n + mass)  # of a context: what each step out of it is divided by
        self.hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in tables.words], dtype=np.uint64)
        self.codes = tables.codes
        context, word = tables.codes >> ID_BITS, tables.codes & ID_MASK
        self.arcs = np.log10(tables.pairs + mass * 10 ** self.root[word]) + self.left[context] if len(tables.codes) else np.zeros(0)
        self.seen = tables.seen
        self.never = math.log10(ADDED / tables.norm)
        # what goes to the shards, by context: occurrences without an arc
        self.sent = np.cumsum(n - np.bincount(context, weights=tables.pairs, minlength=len(n)) + 1.0) if len(n) else np.zeros(0)
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shards_of(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shard of each context, and how many it has."""
        if shards not in self.ranges:
            upto = np.minimum(self.sent / self.sent[-1] * shards, shards - 1).astype(np.int64) if len(self.sent) else np.zeros(0, dtype=np.int64)
            first = np.concatenate([[0], upto[:-1]])[: len(upto)]
            self.ranges[shards] = first, upto - first + 1
        return self.ranges[shards]

    def may_be_seen(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.seen) > 0)
        for k in SHIFTS if len(self.seen) else ():
            at = (hashes >> np.uint64(k)) & np.uint64(8 * len(self.seen) - 1)
            out &= self.seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out

    def traverse(self, texts: Sequence[bytes | None], learnt: np.ndarray | None = None) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
        """Per text: tokens, tokens with a state, base score of these and of words never learnt, score so far. And the places for the
        shards, of three kinds: pairs of two words with a state (text, code), pairs whose context has none (text, pair's hash, word),
        and words without (text, word's hash, context's hash or 0 at a text's begin, whether it is the end token).

        With ``learnt``, one truth value a text, also the score so far of learnt texts without their own counts; places then end in
        how often a learnt text has the word again, for the third kind in how many tokens it has, and in 0 for other texts."""
        lists = [tokens_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        words = [w for x in lists for w in x]
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(sizes)
        first, last = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
        first[ends - sizes], last[ends - 1] = True, True
        known, at = ids >= 0, np.maximum(ids, 0)
        plain = np.where(known, self.root[at], 0.0) if len(self.root) else np.zeros(len(ids))
        hashes = self.hashes[at] if len(self.hashes) else np.zeros(len(ids), dtype=np.uint64)
        away = np.flatnonzero(~known)
        hashes[away] = np.fromiter((xxhash.xxh64_intdigest(words[i], SEED) for i in away.tolist()), dtype=np.uint64, count=len(away))
        never = np.zeros(len(ids), dtype=bool)
        never[away] = ~self.may_be_seen(hashes[away])
        plain[never] = self.never
        before, before_known = np.concatenate([[0], at[:-1]]), np.concatenate([[False], known[:-1]]) & ~first
        prior = np.where(first, np.uint64(0), np.concatenate([[np.uint64(0)], hashes[:-1]]) | np.uint64(1))
        score = plain.copy()
        # an arc, else the failure arc and the start's arc
        code = before << ID_BITS | at
        spot = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        arc = known & before_known & (self.codes[spot] == code) if len(self.codes) else np.zeros(len(ids), dtype=bool)
        score[arc] = self.arcs[spot[arc]]
        score[(known | never) & ~first & ~arc] += self.log_mass
        score[never & ~last] -= self.log_mass
        away = before_known & ~arc
        score[away] += self.left[before[away]]
        both = known & before_known & ~arc
        half = known & ~first & ~before_known & ~np.concatenate([[False], never[:-1]])
        rare = ~known & ~never
        places = [
            (text[both], code[both].astype(np.uint64)), (text[half], mixed(prior[half], hashes[half]), at[half]), (text[rare], hashes[rare], prior[rare], last[rare]),
        ]
        total = lambda values: np.bincount(text, weights=values, minlength=len(texts))
        found = [sizes, total(known).astype(np.int64), total(plain), total(score)]
        if learnt is None:
            return found, places
        mine = learnt[text]
        own, own_pair = (_repeats(text << bits | key, mine & some) for bits, key, some in ((ID_BITS, at, known), (2 * ID_BITS, code, arc)))
        away, here = np.flatnonzero(before_known & ~arc & mine), np.flatnonzero(known & mine)
        rest = lambda i: self.counts[before[i]] - own[i - 1] + self.mass
        p = (self.counts[at[here]] - own[here] + ADDED) / (self.norm - sizes[text[here]])
        apart = np.where(mine, 0.0, score)
        apart[here] = np.log10(p)
        if arc.any():
            met = arc[here]
            some = here[met]
            apart[some] = np.log10(self.pairs[spot[some]] - own_pair[some] + self.mass * p[met]) - np.log10(rest(some))
        apart[known & mine & ~first & ~arc] += self.log_mass
        apart[away] -= np.log10(rest(away))
        own_size = np.where(mine, sizes[text], 0)
        again = np.maximum(own - 1, 0)
        return [*found, total(apart)], [(*places[0], again[both]), (*places[1], again[half]), (*places[2], own_size[rare])]


def _repeats(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    """How often a key occurs among those ``where`` holds, 0 for the others."""
    out = np.zeros(len(keys), dtype=np.int64)
    _, place, n = np.unique(keys[where], return_inverse=True, return_counts=True)
    out[where] = n[place]
    return out


_AUTOMATA: dict[str, Automaton] = {}


def automaton_of(tables: Tables) -> Automaton:
    """One per worker process and model."""
    if tables.key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[tables.key] = Automaton(tables)
    return _AUTOMATA[tables.key]


#: Bytes of each column of the three kinds of places; a text's place in its parcel comes first, with the fold in its top bit.
WIDTHS = ((2, 3, 3), (2, 8, ID_BITS // 8), (2, 8, 8, 1))
#: The same with the last column of ``apart``, whose high bytes hardly ever differ from nought.
APART_WIDTHS = tuple((*widths, 4) for widths in WIDTHS)
MOST_TEXTS = 1 << 15


def packed_places(places: list[tuple[np.ndarray, ...]], held: np.ndarray, shards: int, automaton: Automaton) -> list[tuple[int, bytes]]:
    """Parcels of places by shard: a range of contexts for pairs of words with a state, of hashes for the others."""
    first, many = automaton.shards_of(shards)
    sorted_kinds = []
    for number, kind in enumerate(places):
        text = kind[0].astype(np.uint64) | held[kind[0]].astype(np.uint64) << np.uint64(15)
        columns = [text, *(c.astype(np.uint64) for c in kind[1:])]
        key = columns[1]
        if number == 0:
            context = (key >> np.uint64(ID_BITS)).astype(np.int64)
            word = mixed(key & np.uint64(ID_MASK), np.full(len(key), 17, dtype=np.uint64)) >> np.uint64(33)
            shard = first[context] + word.astype(np.int64) % many[context]
        else:
            shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((key, shard))
        shard = shard[order]
        sorted_kinds.append(([c[order] for c in columns], np.searchsorted(shard, np.arange(shards + 1)), number == 0, shard))
    out, every = [], APART_WIDTHS if len(places[0]) > 2 else WIDTHS
    for k in np.unique(np.concatenate([shard for *_, shard in sorted_kinds])).tolist():
        parts = [np.array([bounds[k + 1] - bounds[k] for _, bounds, *_ in sorted_kinds], dtype="<u4").tobytes()]
        for (columns, bounds, pairs, _), widths in zip(sorted_kinds, every):
            text, key, *more = (c[bounds[k] : bounds[k + 1]] for c in columns)
            steps = pair_steps(key) if pairs else (np.diff(key, prepend=np.uint64(0)),)
            parts += [planes(c, w) for c, w in zip((text, *steps, *more), widths)]
        out.append((k, squeezed(b"".join(parts))))
    return out


def settle(parcels: list[tuple[int, bytes]], tables: Tables, apart: bool = False) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What all places of one shard add to their texts. Pairs seen of words with a state: row, count, word; and what words
    without a state add: row, score, base score, known tokens, one row per text.

    ``apart``: pairs also with how often a learnt text has the pair again and the word beside it, as one number; what words add also
    without the text's own counts, after the score. ``parcels``: number of the parcel's first text, packed places.
    """
    kinds: list[list[list[np.ndarray]]] = [[], [], []]
    for number, data in parcels:
        view = unsqueezed(data)
        sizes, at = np.frombuffer(view[:12], dtype="<u4").tolist(), 12
        for kind, (n, widths) in enumerate(zip(sizes, APART_WIDTHS if apart else WIDTHS)):
            columns = []
            for width in widths:
                columns.append(from_planes(view[at : at + n * width], n, width))
                at += n * width
            columns[1:] = [from_pair_steps(*columns[1:3]), *columns[3:]] if kind == 0 else [np.cumsum(columns[1], dtype=np.uint64), *columns[2:]]
            learnt = columns[0] >> np.uint64(15) == 0
            row = (columns[0] & np.uint64(MOST_TEXTS - 1)).astype(np.int64) + number
            kinds[kind].append([row, learnt, *columns[1:]])
    both, half, rare = ([np.concatenate(c) for c in zip(*kind)] for kind in kinds)

    def seen(keys: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        _, place = np.unique(keys, return_inverse=True)
        return np.bincount(place, weights=learnt)[place] if len(keys) else np.zeros(0)

    def of_text(keys: np.ndarray, row: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        return _repeats(mixed(keys, row.astype(np.uint64)), learnt)

    arcs = []
    for (row, learnt, key), word, more in ((both[:3], both[2] & np.uint64(ID_MASK), both[3:]), (half[:3], half[3], half[4:])):
        n = seen(key, learnt)
        columns = (row, n, word, *(two_as_one(np.maximum(of_text(key, row, learnt) - 1, 0), again) for again in more))
        arcs.append(tuple(c[n > 0].astype(np.int64) for c in columns))
    row, learnt, word, context, end, *more = rare
    n, pair = seen(word, learnt), seen(mixed(context, word), learnt)

    def told(n: np.ndarray, pair: np.ndarray, norm: float | np.ndarray) -> np.ndarray:
        p = (n + ADDED) / norm
        return np.where(context == 0, np.log10(p), np.log10(pair + tables.mass * p)) - np.where(end == 0, np.log10(n + tables.mass), 0.0)

    scores = [told(n, pair, tables.norm)]
    if apart:
        scores.append(told(n - of_text(word, row, learnt), pair - of_text(mixed(context, word), row, learnt), tables.norm - more[0].astype(np.float64)))
    row, place = np.unique(row, return_inverse=True)
    total = lambda values: np.bincount(place, weights=np.rint(values), minlength=len(row)).astype(np.int64)
    return tuple(np.concatenate(c) for c in zip(*arcs)), (row, *(total(s / UNIT) for s in scores), total(np.log10((n + ADDED) / tables.norm) / UNIT), total(n > 0))


def two_as_one(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Two whole numbers, the first no greater than the second, as one: small ones give a small one, mostly 0."""
    whole = whole.astype(np.int64)
    return whole * (whole + 1) // 2 + part


def one_as_two(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = ((np.sqrt(8.0 * code + 1) - 1) / 2).astype(np.int64)
    return code - whole * (whole + 1) // 2, whole


#: Scores are summed up as whole numbers of this unit, so that sums don't depend on an order.
UNIT = 2.0**-36


def returned(parcels: list[tuple[int, bytes]], tables: Tables, apart: bool = False) -> list[tuple[int, bytes]]:
    """``settle`` for each parcel's texts, packed, by the parcel's run, texts by their place in it. A pair travels as its count and
    word, which take half the bytes of what it adds to the score."""
    runs = np.unique(np.array([run for run, _ in parcels], dtype=np.int64))
    sides = []
    for columns in settle(parcels, tables, apart):
        # a text's words in order, so that they travel in fewer bytes
        order = np.lexsort((columns[2], columns[0]))
        columns = [c[order] for c in columns]
        sides.append((columns, np.searchsorted(columns[0], np.append(runs, np.iinfo(np.int64).max))))
    out = []
    for k, run in enumerate(runs.tolist()):
        (arcs, rare), sizes, parts = ([c[bounds[k] : bounds[k + 1]] for c in columns] for columns, bounds in sides), [], []
        for kind, (row, *columns) in enumerate((arcs, rare)):
            sizes.append(len(row))
            parts.append(planes(np.diff(row - run, prepend=0), 2))
            if kind == 0:
                parts += [planes(x, width) for x, width in zip(columns, (8, 3, 8))]
            else:
                # of small numbers below zero only the lowest bytes differ from nought
                parts += [*(planes(x << 1 ^ x >> 63, 8) for x in columns[:-1]), planes(columns[-1], 4)]
        if any(sizes):
            out.append((run, squeezed(b"".join([np.array(sizes, dtype="<u4").tobytes(), *parts]))))
    return out


def added_up(parcels: list[bytes], tables: Tables, own_sizes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Score, base score and known tokens by place of the text, over all shards. ``own_sizes``, the tokens of learnt texts and 0 for
    others, by place: also the score without the text's own counts."""
    out = np.zeros((4, MOST_TEXTS))
    sums = ((0, 2), (1, 10)) if own_sizes is None else ((0, 2), (3, 10), (1, 18))
    for view in map(unsqueezed, parcels):
        n, m = np.frombuffer(view[:8], dtype="<u4").tolist()
        arcs, rare = view[8:], view[8 + (13 if own_sizes is None else 21) * n :]
        if n:
            text = np.cumsum(from_planes(arcs, n, 2)).astype(np.int64)
            count, word = from_planes(arcs[2 * n :], n, 8).astype(np.float64), from_planes(arcs[10 * n :], n, 3).astype(np.int64)
            added = lambda count, norm, whole: np.rint(np.log10(1 + count * norm / (tables.mass * (whole + ADDED))) / UNIT)
            whole = added(count, tables.norm, tables.counts[word])
            out[0] += np.bincount(text, weights=whole, minlength=MOST_TEXTS)
            if own_sizes is not None:
                mine = own_sizes[text] > 0
                own_pair, own = (1 + again for again in one_as_two(from_planes(arcs[13 * n :], n, 8)[mine].astype(np.int64)))
                whole[mine] = added(count[mine] - own_pair, tables.norm - own_sizes[text[mine]], tables.counts[word[mine]] - own)
                out[3] += np.bincount(text, weights=whole, minlength=MOST_TEXTS)
        text = np.cumsum(from_planes(rare, m, 2)).astype(np.int64)
        for to, begin in sums:
            folded = from_planes(rare[begin * m :], m, 8)
            out[to][text] += (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)
        out[2][text] += from_planes(rare[(sums[-1][1] + 8) * m :], m, 4).astype(np.int64)
    return {"score": out[0] * UNIT, "base_score": out[1] * UNIT, "n_known": out[2].astype(np.int64), "apart": out[3] * UNIT}


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, words_bound: int = 1_000_000, pairs_bound: int = 50_000, mass: float = 40.0,
    parcel_bytes: int = 1_500_000, shard_tokens: int = 1_000_000,
) -> DataFrame:
    """Score every whole text with a model of the texts outside the held-out fold.

    Returns the id, ``held_out`` (crc32 of the id as text is 0 modulo ``fold``; false for null ids, which are learnt
    from), ``n_tokens`` and ``n_known`` (tokens seen in training), ``train_tokens`` (long), ``base_score`` and ``score``
    (double, log10). ``mass`` is how many occurrences of a context the words' own frequencies count for. Every text ends
    in one end token, so a null or empty one has that token alone. Without training texts all probabilities are one.
    Repeated rows give repeated rows, an empty table an empty one; other columns are dropped, whatever their names.
    ``df`` is to be a stored table: its rows are numbered as they are read, and read again if an executor is lost.

    Texts are traversed ``parcel_bytes`` at a time; places travel in parcels, packed, from ``STRETCHES`` times as much to a shard. There are
    enough shards that one has the places of about ``shard_tokens`` tokens, which is what a task holds at a time.
    """
    small_batches(df)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"), F.coalesce(remainder(id_col, fold) == 0, F.lit(False)).alias("held_out"))
    return score_rows(rows, words_bound, pairs_bound, mass, parcel_bytes, shard_tokens).withColumnRenamed("id", id_col)


STRETCHES = 4


def score_rows(
    rows: DataFrame, words_bound: int = 1_000_000, pairs_bound: int = 50_000, mass: float = 40.0, parcel_bytes: int = 1_500_000, shard_tokens: int = 1_000_000, tokens: int | None = None,
    most_words: int = 1_000_000, apart: bool = False,
) -> DataFrame:
    """``score_documents`` for rows of ``id`` (of any type), ``t`` (binary) and ``held_out``: the others are learnt from. ``tokens``:
    about how many there are in all rows, if many more than are learnt from. ``apart`` adds a column of that name: the score, for rows
    learnt from that under the counts without the row itself."""
    tables = train_tables(rows.where(~F.col("held_out")).select("t"), words_bound, pairs_bound, mass, most_words)
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    shards = 1 + max(tables.total, tokens or 0) // shard_tokens
    # a row per text, and rows with a parcel; both know their run, the number of its first text
    numbered = rows.select("id", F.monotonically_increasing_id().alias("row"), "held_out", "t")
    fields = (("row", T.LongType()), ("run", T.LongType()), ("shard", T.IntegerType()), ("parcel", T.BinaryType()), ("held_out", T.IntegerType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), *((("apart", T.DoubleType()),) if apart else ()))
    # a parcel's row has no id
    schema = T.StructType([T.StructField("id", numbered.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])
    names = schema.names
    results = T.StructType([f for f in schema if f.name not in ("row", "run", "shard", "parcel")])

    def runs(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
        """Stretches of a batch of about ``parcel_bytes``; a longer text is one by itself."""
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"") + 8
            if size > parcel_bytes or i + 1 - begin >= MOST_TEXTS:
                yield begin, i + 1
                begin, size = i + 1, 0
        if begin < len(texts):
            yield begin, len(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        texts_held: list[tuple] = []
        places_held: list[list[tuple[np.ndarray, ...]]] = []
        n = size = 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in texts_held])
            number, held, sizes, known, *sums = (np.concatenate(c) for c in list(zip(*texts_held))[1:])
            parcels = packed_places([tuple(np.concatenate(c) for c in zip(*kind)) for kind in zip(*places_held)], held, shards, automaton)
            more = len(parcels)
            none = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(more, kind)])
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, pa.nulls(more, ids.type)]), none(number, pa.int64()), pa.array(np.full(n + more, number[0])),
                pa.array(np.concatenate([number % shards, np.array([k for k, _ in parcels], dtype=np.int64)]).astype(np.int32)), pa.array([None] * n + [p for _, p in parcels], pa.binary()),
                none(held.astype(np.int32), pa.int32()), none(sizes, pa.int64()), none(known, pa.int64()), *(none(c, pa.float64()) for c in sums),
            ], names=names)

        for batch in batches:
            texts, number = batch.column(3).to_pylist(), batch.column(1).to_numpy()
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for begin, end in runs(texts):
                if n and (n + end - begin > MOST_TEXTS or size > STRETCHES * parcel_bytes or number[begin] - texts_held[0][1][0] != n):
                    yield out()
                    texts_held, places_held, n, size = [], [], 0, 0
                found, places = automaton.traverse(texts[begin:end], ~held[begin:end] if apart else None)
                texts_held.append((batch.column(0).slice(begin, end - begin), number[begin:end], held[begin:end], *found))
                places_held.append([(kind[0] + n, *kind[1:]) for kind in places])
                n, size = n + end - begin, size + sum(len(t or b"") for t in texts[begin:end])
        if n:
            yield out()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, shard, parcels = shared.value, None, []

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            back = returned(parcels, tables, apart)
            columns = {"run": pa.array([r for r, _ in back], pa.int64()), "parcel": pa.array([p for _, p in back], pa.binary())}
            return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(len(back), t)) for n, t in zip(names, kinds)], names=names)

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            yield batch.filter(batch.column("parcel").is_null())
            some = batch.filter(batch.column("parcel").is_valid())
            for k, run, parcel in zip(some.column("shard").to_pylist(), some.column("run").to_pylist(), some.column("parcel").to_pylist()):
                if k != shard and parcels:
                    yield out(kinds)
                    parcels = []
                shard = k
                parcels.append((run, parcel))
        if parcels:
            yield out(kinds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole.filter(whole.column("parcel").is_null())
            place = texts.column("row").to_numpy() - texts.column("run")[0].as_py()
            own_sizes = None
            if apart:
                own_sizes = np.zeros(MOST_TEXTS, dtype=np.int64)
                own_sizes[place] = np.where(texts.column("held_out").to_numpy() == 1, 0, texts.column("n_tokens").to_numpy())
            added = added_up(whole.column("parcel").drop_null().to_pylist(), tables, own_sizes)
            columns = {n: texts.column(n).to_numpy() + values[place] for n, values in added.items() if n in names}
            return pa.RecordBatch.from_arrays([pa.array(columns[n]) if n in columns else texts.column(n).combine_chunks() for n in results.names], names=results.names)

        for batch in batches:
            run = batch.column("run").to_numpy()
            starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for begin, end in zip(starts, starts[1:]):
                if begin == end:
                    continue
                if held and held[0].column("run")[0].as_py() != int(run[begin]):
                    yield out()
                    held.clear()
                held.append(batch.slice(begin, end - begin))
        if held:
            yield out()

    sent = numbered.mapInArrow(send, schema).repartition("shard").sortWithinPartitions("shard")
    back = sent.mapInArrow(receive, schema).repartition("run").sortWithinPartitions("run")
    more = ["apart"] if apart else []
    return back.mapInArrow(finish, results).select("id", (F.col("held_out") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(tables.total).cast("long").alias("train_tokens"), "base_score", "score", *more)
