"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A byte sequence has one tokenisation that BPE yields, and a token sequence is that tokenisation exactly when each two
neighbours, encoded alone, stay as they are. So the merges become a nondeterministic transducer: a state is the last
token plus a place in the vocabulary's trie; reading a byte goes one step down the trie and may end a token that suits
its predecessor. ``Transducer`` determinises it on demand: a state holds every live (pending tokens, trie place) pair,
emits the prefix that all of them share, and remembers its arcs. A token is at most ``longest`` bytes, which bounds the
lookahead after which it is emitted. The number of
arcs is bounded; beyond it the nondeterministic machine is simulated, and results don't change.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from headcast.llm.arrowmap import with_document_columns
from headcast.llm.pieces import Memo, Splitter


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


#: Answers about pairs that are remembered (a power of two).
PAIR_SLOTS = 1 << 18


class Merges:
    """What BPE by ranks does next to a boundary between two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs = array("Q", bytes(8 * PAIR_SLOTS))  # answers by a hash of the pair; a later pair takes the slot

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte or for a token that no merge makes."""
        if token not in self._halves:
            parts = self.merge(self.bytes_of[token], below=token)
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def merge(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Plain BPE with the merges ranked under ``below``: the leftmost pair of the lowest rank first."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes gives back these two tokens."""
        key = left << 32 | right
        slot = (left * 40_503 ^ right * 2_971) & PAIR_SLOTS - 1
        known = self._pairs[slot]
        if known >> 1 == key + 1:
            return bool(known & 1)
        found = self._stay_apart(left, right)
        self._pairs[slot] = key + 1 << 1 | found
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        # Undo merges, latest first. While the pair (left, right) stands at the boundary, the merge that ends this
        # is the earlier of those that used left and right; a join of the pair ranked before it would have come first.
        ranks, bytes_of = self.ranks, self.bytes_of
        until_left = until_right = 1 << 62
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < until_left and joined <= until_right:
                # equal ranks: the same merge further left goes first, so the right side's merge loses to the join
                return False
            halves_left, halves_right = self.halves(left), self.halves(right)
            if halves_left is None and halves_right is None:
                return True
            if halves_right is None or halves_left is not None and left > right:
                until_left, left = left, halves_left[1]
                until_right = min(until_right, until_left)
            else:
                until_right, right = right, halves_right[0]
                until_left = min(until_left, until_right + 1)


class Transducer:
    """Bytes in, token ids out (packed, little-endian); arcs are found when first taken.

    A state is a number; its arc for a byte stands under ``state << 8 | byte`` as ``next state << 32 | place of what it
    emits``. Once there are ``max_arcs``, what only new arcs need is let go, and a piece that takes an unknown arc is
    run through the nondeterministic machine instead.
    """

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = 250_000):
        self.merges = Merges(ranks)
        self.max_arcs = max_arcs
        self.longest = max(map(len, ranks), default=0)
        self._next: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._inner = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._inner[node] = 1
                key = node << 8 | byte
                if key not in self._next:
                    self._next[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(0)
                node = self._next[key]
            self._token[node] = rank
        self._emitted: list[bytes] = []
        self._places: dict[bytes, int] = {}
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._arcs: dict[int, int] = {}
        self._ends = array("q")  # by state: place of what the end of a piece emits, -1 if no piece ends there
        self.start = self._id((-1, (((), 0),)))

    def _place(self, emitted: bytes) -> int:
        found = self._places.setdefault(emitted, len(self._emitted))
        if found == len(self._emitted):
            self._emitted.append(emitted)
        return found

    def _id(self, state: tuple) -> int:
        found = self._ids.get(state)
        if found is None:
            found = self._ids[state] = len(self._states)
            self._states.append(state)
            self._ends.append(next((self._place(pack(pending)) for pending, node in state[1] if node == 0), -1))
        return found

    def _arc(self, at: int, byte: int) -> int:
        last, live = self._states[at]
        moved, ended = [], None
        for pending, node in live:
            child = self._next.get(node << 8 | byte)
            if child is None:
                continue
            token = self._token[child]
            if token >= 0 and ended is None:
                before = pending[-1] if pending else last
                if before < 0 or self.merges.neighbours(before, token):
                    ended = (*pending, token)
            if self._inner[child]:
                moved.append((pending, child))
        if ended is not None:
            moved.append((ended, 0))
        if not moved:
            raise ValueError("a byte is missing from the vocabulary")
        first, common = moved[0][0], len(min((p for p, _ in moved), key=len))
        for pending, _ in moved[1:]:
            i = 0
            while i < common and pending[i] == first[i]:
                i += 1
            common = i
        emitted = first[:common]
        rest = tuple((p[common:], n) for p, n in moved)
        last = emitted[-1] if emitted else last
        if all(p for p, _ in rest):
            last = -1  # no live pair looks at it any more
        arc = self._arcs[at << 8 | byte] = self._id((last, rest)) << 32 | self._place(pack(emitted))
        if len(self._arcs) >= self.max_arcs:
            self._ids, self._states, self._places = {}, [], {}
        return arc

    def packed(self, piece: bytes) -> bytes:
        """Token ids of one pre-token; a piece that is itself in the vocabulary is one token."""
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return pack((whole,))
        out, at, known, emitted = [], self.start, self._arcs.get, self._emitted
        for byte in piece:
            arc = known(at << 8 | byte)
            if arc is None:
                if len(self._arcs) >= self.max_arcs:
                    return pack(self.simulate(piece))
                arc = self._arc(at, byte)
            at = arc >> 32
            out.append(emitted[arc & 0xFFFFFFFF])
        if self._ends[at] < 0:
            raise ValueError("the vocabulary cannot spell this piece")
        out.append(emitted[self._ends[at]])
        return b"".join(out)

    def simulate(self, piece: bytes) -> list[int]:
        """One run of the nondeterministic transducer, the longest token first.

        Only one valid sequence of tokens leads to a place, so a place from which none goes on is never tried again.
        """
        n, child, token, apart = len(piece), self._next.get, self._token, self.merges.neighbours
        dead, taken, left = bytearray(n + 1), [], []
        begin, before = 0, -1
        while begin < n:
            open_ends, node = [], 0
            for end in range(begin, n):
                node = child(node << 8 | piece[end])
                if node is None:
                    break
                if token[node] >= 0:
                    open_ends.append((end + 1, token[node]))
            while True:
                while open_ends:
                    end, found = open_ends.pop()
                    if not dead[end] and (before < 0 or apart(before, found)):
                        break
                else:
                    if not left:
                        raise ValueError("the vocabulary cannot spell this piece")
                    dead[begin] = 1
                    taken.pop()
                    begin, before, open_ends = left.pop()
                    continue
                break
            left.append((begin, before, open_ends))
            taken.append(found)
            begin, before = end, found
        return taken

    def encode(self, piece: bytes) -> list[int]:
        return list(array("I", self.packed(piece)))


def pack(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return b"".join([i.to_bytes(4, "little") for i in ids])


class StreamDecoder:
    """Text of a stream of token ids. Bytes of an unfinished character wait for the next ids.

    ``need`` and ``low``..``high`` are the state of a UTF-8 automaton: how many continuation bytes are missing and
    the range of the next one. Only the tail of a chunk has to be walked, from its last lead byte.
    """

    def __init__(self, bytes_of: Mapping[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character which may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need, low, high = UTF8_LEADS.get(lead, (0, 0, 0))
                for byte in data[len(data) - back + 1 :]:
                    if not low <= byte <= high:
                        return 0
                    need, low, high = need - 1, 0x80, 0xBF
                return back if need > 0 else 0
        return 0


#: Fixed values of UTF-8: for each lead byte, continuation bytes and the range of the first of them.
UTF8_LEADS = {
    **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
    0xE0: (2, 0xA0, 0xBF),
    **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)},
    0xED: (2, 0x80, 0x9F),
    0xF0: (3, 0x90, 0xBF),
    **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)},
    0xF4: (3, 0x80, 0x8F),
}


class Encoder:
    """Whole texts to ids: split by the pattern, each match through the transducer. What short matches gave is remembered,
    at most ``memo`` recent and ``memo`` older ones."""

    def __init__(self, blob: bytes, pattern: str, memo: int = 80_000):
        self.ranks = read_ranks(blob)
        self.transducer = Transducer(self.ranks)
        self.bytes_of = self.transducer.merges.bytes_of
        self.split = Splitter(pattern)
        self.memo = Memo(lambda piece: self.transducer.packed(piece.encode("utf-8")), memo)

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def shared_encoder(blob: bytes, pattern: str) -> Encoder:
    """One per worker process: later tasks of the process go on with what earlier ones have learnt."""
    return Encoder(blob, pattern)


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), with_ids: bool = False, chunk: int = 65_536
) -> DataFrame:
    """Encode each whole text, decode the ids again, and report both.

    Adds ``n_tokens`` (long), ``ids_sha256``, ``decoded_sha256`` (lowercase hex), ``round_trip`` (boolean: the decoded
    text equals the text) and, on request, ``token_ids`` (array of int). A null text counts as empty: no tokens, both
    hashes those of nothing. Repeated rows give repeated rows, an empty table an empty table. Columns outside ``keep``
    are dropped. ``vocabulary`` is a path of a rank file, read on the driver and broadcast: a vocabulary doesn't grow
    with the data. ``chunk`` is how many ids the decoder is fed at a time.
    """
    with open(vocabulary, "rb") as file:
        blob = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        encoder = shared_encoder(blob.value, pattern)

        def work(texts: list[bytes | None]):
            counts, ids_hash, decoded_hash, same, ids_out = [], [], [], [], []
            for data in texts:
                text = (data or b"").decode("utf-8", "replace")
                packed = encoder.packed(text)
                ids = np.frombuffer(packed, dtype="<u4")
                decoder, decoded, whole = StreamDecoder(encoder.bytes_of), hashlib.sha256(), []
                for at in range(0, len(ids), chunk):
                    whole.append(decoder.feed(ids[at : at + chunk].tolist()))
                    decoded.update(whole[-1].encode("utf-8"))
                whole.append(decoder.end())
                decoded.update(whole[-1].encode("utf-8"))
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                decoded_hash.append(decoded.hexdigest())
                same.append("".join(whole) == text)
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
            return [counts, ids_hash, decoded_hash, same, *([ids_out] if with_ids else [])]

        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    return with_document_columns(df, text_col, keep, [*fields, *([("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])], make)
