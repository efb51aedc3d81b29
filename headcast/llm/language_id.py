"""Language identification by cross-parsing: how few longest matches against a language's text spell a document.

A suffix automaton of some labelled text per language knows every substring of it. Parsing a document greedily into the
longest substrings it knows takes few phrases in the right language. Here an automaton is compiled to a table of
(place, letter) to (next place, whether a phrase begins), and many texts are stepped through it together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.llm.arrowmap import with_document_columns

UNDETERMINED = "und"
#: So few texts are finished letter by letter rather than as vectors.
FEW = 32


def suffix_automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Arcs of the suffix automaton of a sequence; place 0 is its start."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in arcs[at]:
            arcs[at][code] = new
            at = link[at]
        if at >= 0:
            target = arcs[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and arcs[at].get(code) == target:
                    arcs[at][code] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return arcs


class PhraseTable:
    """Next steps of an automaton: for (place, code) twice the next place, plus one if the letter begins a new phrase.

    A letter that no sample has is a phrase of its own. Up to ``dense`` entries the steps lie in one array; a larger
    alphabet's arcs are kept sorted and searched, so memory follows the arcs. Both give the same steps.
    """

    def __init__(self, arcs: list[dict[int, int]], letters: int, dense: int = 8_000_000):
        self.letters = letters
        self.start = np.ones(letters, dtype=np.int32)
        for code, target in arcs[0].items():
            self.start[code] = 2 * target + 1
        # the start itself always begins a phrase
        pairs = [(place * letters + code, 2 * target) for place, out in enumerate(arcs) if place for code, target in out.items()]
        keys, steps = np.array([k for k, _ in pairs], dtype=np.int64), np.array([t for _, t in pairs], dtype=np.int32)
        self.flat = None
        if len(arcs) * letters <= dense:
            self.flat = np.tile(self.start, len(arcs))
            self.flat[keys] = steps
        else:
            order = np.argsort(keys)
            self.keys, self.steps = keys[order], steps[order]

    def __call__(self, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = place.astype(np.int64) * self.letters + code
        if self.flat is not None:
            return self.flat[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.steps[at], self.start[code])

    def count(self, codes: np.ndarray, place: int) -> int:
        """Phrases that begin in ``codes``, from a place on, letter by letter."""
        phrases = 0
        if self.flat is None:
            for code in codes.tolist():
                step = int(self(np.array([place]), np.array([code]))[0])
                phrases, place = phrases + (step & 1), step >> 1
            return phrases
        flat, letters = memoryview(self.flat), self.letters
        for code in codes.tolist():
            step = flat[place * letters + code]
            phrases += step & 1
            place = step >> 1
        return phrases


class Parser:
    """Tables of all languages over one alphabet, built from their sample texts."""

    def __init__(self, samples: Sequence[tuple[str, str]]):
        self.languages = [name for name, _ in samples]
        letters = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.size = len(letters) + 2  # 0: between words; 1: a letter that no sample has
        code = {c: i + 2 for i, c in enumerate(letters)}
        self.codes = np.zeros(0x110000, dtype=np.int32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                self.codes[point] = code.get(c.lower(), 1)
        self.tables, self.bits = [], []
        for _, text in samples:
            sample = self.read(text)
            self.tables.append(PhraseTable(suffix_automaton(sample.tolist()), self.size))
            self.bits.append(math.log2(len(sample) + 2))

    def read(self, text: str) -> np.ndarray:
        """Letter codes; all that isn't a letter becomes one gap between words."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = self.codes[points]
        gap = codes == 0
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        return codes[keep]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        read = [self.read(t) if t else np.zeros(0, dtype=np.int32) for t in texts]
        judged = [i for i, c in enumerate(read) if len(c) and c.any()]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not judged or not self.languages:
            return names, scores
        # all texts step together, longest first; once few are left, each is finished by itself
        judged.sort(key=lambda i: -len(read[i]))
        sizes = np.array([len(read[i]) for i in judged])
        data = np.concatenate([read[i] for i in judged])
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        together = int(sizes[FEW]) if len(sizes) > FEW else 0
        live = np.searchsorted(-sizes, -np.arange(together), side="left").tolist()
        costs = np.empty((len(judged), len(self.languages)))
        for k, table in enumerate(self.tables):
            place, phrases = np.zeros(len(judged), dtype=np.int64), np.zeros(len(judged), dtype=np.int64)
            for at, m in enumerate(live):
                step = table(place[:m], data[begin[:m] + at])
                phrases[:m] += step & 1
                place[:m] = step >> 1
            for j in range(int(np.searchsorted(-sizes, -together, side="left"))):
                phrases[j] += table.count(data[begin[j] + together : begin[j] + sizes[j]], int(place[j]))
            costs[:, k] = phrases * self.bits[k] / sizes
        best = costs.argmin(axis=1)
        low = costs[np.arange(len(judged)), best]
        if len(self.languages) > 1:
            costs[np.arange(len(judged)), best] = np.inf
            score = np.clip(1 - low / costs.min(axis=1), 0, 1)
        else:
            score = np.ones(len(judged))
        for row, i in enumerate(judged):
            names[i], scores[i] = self.languages[best[row]], float(score[row])
        return names, scores


@lru_cache(maxsize=1)
def shared_parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One per worker process."""
    return Parser(samples)


def sample_languages(training: DataFrame, text_col: str = "text", lang_col: str = "lang", letters: int = 24_000, texts: int = 64, longest: int = 6_000) -> list[tuple[str, str]]:
    """Whole texts of each language until there are ``letters`` characters, at most ``texts`` different ones: the fitting bound.

    Texts are taken in the order of a hash of their content, those of over ``longest`` characters after the others, so the
    choice doesn't depend on partitioning, ids or sources, and copies count once. Only hashes are ranked; then the chosen
    texts are read. Null texts and languages aren't learnt from; an empty table gives no samples.
    """
    text = F.col(f"`{text_col}`").cast("string")
    # ranked by size class and hash: the limit is pushed below the exchange, so that a common language sends 64 rows per task
    rows = training.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), (F.char_length(text) > longest).alias("long"), F.xxhash64(text).alias("key"), text.alias("text")
    )
    first = Window.partitionBy("lang").orderBy("long", "key")
    chosen = rows.select("lang", "long", "key").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= texts).select("lang", "key", "rank")
    found = rows.select("lang", "key", "text").join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    samples: dict[str, str] = {}
    for row in found.orderBy("lang", "rank").toLocalIterator():
        have = samples.get(row.lang, "")
        if len(have) < letters:
            samples[row.lang] = have + "\n" + row.text
    return sorted((lang, text) for lang, text in samples.items() if any(c.isalpha() for c in text))


def identify_languages(
    df: DataFrame, samples: Sequence[tuple[str, str]], text_col: str = "text", keep: Sequence[str] = ("doc_id",), slice_rows: int = 2000
) -> DataFrame:
    """Predict the language of each whole text from its letters alone.

    Adds ``lang_pred`` (a language of ``samples``, or ``und`` for a null text, one without letters, or no samples) and
    ``score`` (0 to 1: how much shorter the parse is than the second best; 1 if only one language is known). A text is
    parsed whole, however long; phrases are normalised by the text's length and the sample's. Ties go to the first
    language in order. Repeated rows give repeated rows, an empty table an empty one; kept columns named like a result
    are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(samples))

    def make():
        parser = shared_parser(shared.value)

        def work(texts: list[bytes | None]):
            names, scores = [], []
            for at in range(0, len(texts), slice_rows):
                got = parser.predict([t.decode("utf-8", "replace") if t else None for t in texts[at : at + slice_rows]])
                names += got[0]
                scores += got[1]
            return [names, scores]

        return work

    return with_document_columns(df, text_col, keep, [("lang_pred", T.StringType()), ("score", T.DoubleType())], make)
