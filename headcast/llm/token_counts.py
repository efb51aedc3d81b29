"""Token counts under a word-end BPE vocabulary, with a shortcut for words that are proved to be one token."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from headcast.llm.arrowmap import with_document_columns
from headcast.llm.pieces import Memo, Splitter


#: What this module does to texts before it splits them, as vocabulary files name it.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordMerges:
    """Merges over the byte letters of a word whose last letter carries the word-end mark."""

    def __init__(self, order: dict[tuple[str, str], int], end: str):
        self.order, self.end, self.letters = order, end, byte_letters()

    def spell(self, word: bytes) -> list[str]:
        parts = [self.letters[b] for b in word]
        if parts:
            parts[-1] += self.end
        return parts

    def merge(self, parts: list[str]) -> list[str]:
        """The leftmost pair of the earliest merge first, until no pair is left that merges."""
        order, none = self.order, 1 << 62
        ranks = [order.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = order.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = order.get((parts[i], parts[i + 1]), none)
        return parts


def compile_vocabulary(content: bytes) -> dict[str, Any]:
    """What the counting needs of a tokenizer file, with the proved whole tokens.

    A vocabulary string counts as proved if the merges, run on its own letters, end in that one string. Strings that
    no merge order reaches stay out, so the shortcut never gives another count than merging would.
    """
    spec = json.loads(content)
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds != NORMALIZERS:
        raise ValueError(f"texts are normalised by {NORMALIZERS}; the vocabulary wants {kinds}")
    model = spec["model"]
    end = model["end_of_word_suffix"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = {pair: i for i, pair in enumerate(merges)}
    tables = WordMerges(order, end)
    byte_of = {letter: b for b, letter in enumerate(tables.letters)}
    proved = set()
    for token in model["vocab"]:
        body = token[: -len(end)] if token.endswith(end) else ""
        if body and all(c in byte_of for c in body):
            word = bytes(byte_of[c] for c in body)
            if tables.merge(tables.spell(word)) == [token]:
                proved.add(word)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    return {"order": order, "end": end, "proved": frozenset(proved), "split": split, "special": tuple(t["content"] for t in spec["added_tokens"])}


class Counter:
    """Counts of whole texts: normalise, split, take proved words as one token, merge the rest."""

    def __init__(self, vocabulary: dict[str, Any], memo: int = 120_000):
        self.merges = WordMerges(vocabulary["order"], vocabulary["end"])
        self.proved, self.split = vocabulary["proved"], Splitter(vocabulary["split"])
        special = [s for s in vocabulary["special"] if s]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo = Memo(self._word, memo)

    def _word(self, piece: str) -> int:
        word = piece.encode("utf-8")
        return 1 if word in self.proved else len(self.merges.merge(self.merges.spell(word)))

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # letter by letter: a sigma at a word's end is lowered like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.memo.__getitem__, self.split(text.lower())))


_COUNTERS: dict[str, Counter] = {}


@lru_cache(maxsize=2)
def compiled(path: str) -> dict[str, Any]:
    with open(path, "rb") as file:
        return compile_vocabulary(file.read())


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Bytes and tokens of each whole text.

    Adds ``n_bytes`` and ``n_tokens`` (long) and ``over_limit`` (``n_tokens > limit``). A null text counts as empty: no
    bytes, no tokens. The vocabulary's own special strings inside a text count one token each, as its library has it.
    Repeated rows give repeated rows, an empty table an empty table. Columns outside ``keep`` are dropped.
    ``vocabulary`` is a path, read and proved on the driver and broadcast: its size doesn't follow the data.
    """
    tables = df.sparkSession.sparkContext.broadcast(compiled(vocabulary))

    def make():
        if vocabulary not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[vocabulary] = Counter(tables.value)
        counter = _COUNTERS[vocabulary]

        def work(texts: list[bytes | None]):
            counts = [counter(data.decode("utf-8", "replace")) if data else 0 for data in texts]
            return [[len(data or b"") for data in texts], counts, [n > limit for n in counts]]

        return work

    return with_document_columns(df, text_col, keep, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make)
