"""Secrets in texts: three patterns, and long strings whose sliding-window entropy is high. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcast.llm.native import let

#: Fixed values of the base scan: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 or more: runs are whole either way
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY = "entropy"
SPOTS = "array<struct<start:int,kind:int,end:int,value:string>>"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Stands for each character of a base span while the rest is searched; it is no character of any text interchange.
MASK = "\uffff"
#: Candidates that border on no mask, and those that do.
WHOLE = f"(?<![A-Za-z0-9+/_={MASK}-])[A-Za-z0-9+/_=-]{{20,}}+(?!{MASK})"
CUT = f"(?<={MASK})[A-Za-z0-9+/_=-]{{20,}}+|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{20,}}+(?={MASK})"
#: Strings that look random and are no secrets: UUIDs, plain numbers and dates, words joined by dashes or slashes.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"(?i)example|dummy|placeholder|xxxxxx",
)
#: The same, but a word allows only a string that such words make up, with digits and marks. ``ALLOWED`` is what the SQL form uses.
WHOLLY_ALLOWED = (*ALLOWED[:3], r"(?i)^(?:example|dummy|placeholder|x{6,}|[0-9+/_=-])+$")


@dataclass(frozen=True)
class CharacterClass:
    """Strings of ``members`` count as random from ``bits`` of entropy in some window."""

    members: str
    bits: float


#: The first class that fits a candidate decides. No window of 20 characters has exactly these entropies.
CLASSES = (CharacterClass("^[0-9a-fA-F]+$", 3.05), CharacterClass("^[A-Za-z0-9]+$", 3.55), CharacterClass("^.+$", 3.75))


def before(values: Column, zero: Column, both: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each element of an array, ``both`` folded over those before it.

    Blocks are folded first, then what lies before each block, then within the block: no array grows step by step, so
    the work stays near proportional to the array's length.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, both)

    def of_values(v: Column) -> Column:
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))

        def of_ends(ends: Column) -> Column:
            def at(_: Column, i: Column) -> Column:
                nth = F.floor(i / block).cast("int")
                return both(F.get(ends, nth), fold(F.slice(v, nth * block + 1, i % block)))

            return F.transform(v, at)

        totals = F.transform(blocks, lambda k: fold(F.slice(v, k * block + 1, F.lit(block))))
        return let(let(totals, lambda t: F.transform(t, lambda _, k: fold(F.slice(t, F.lit(1), k)))), of_ends)

    return let(values, of_values)


def located(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, value) in code points; ``value`` is ``group``.

    The pieces between matches, with the matches' lengths, give the places. Texts without a match skip all that.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = lambda m: F.transform(m["whole"], F.char_length)

    def placed(m: Column) -> Column:
        steps = F.zip_with(m["size"], F.slice(m["gap"], F.lit(1), F.size(m["size"])), lambda s, g: s + g)

        def spots(p: Column) -> Column:
            def spot(value: Column, i: Column) -> Column:
                start = F.get(p, i) + F.get(m["gap"], i)
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.get(m["size"], i)).alias("end"), value.alias("value"))

            return F.transform(m["value"], spot)

        return let(before(steps, F.lit(0), lambda a, b: a + b), spots)

    found = let(F.struct(whole.alias("whole"), values.alias("value"), gaps.alias("gap")), lambda m: let(F.struct(m["value"].alias("value"), m["gap"].alias("gap"), sizes(m).alias("size")), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPOTS))


def window_entropy(value: Column, width: int = 20) -> Column:
    """The highest entropy (bits a character) of the windows of ``width`` characters of a string.

    With counts c in a window the entropy is log2(width) - sum(c * log2 c) / width. The window moves by one character:
    one count goes up, one down, and the sum follows from these two alone.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    size = len(ALPHABET)
    zero = F.struct(F.array_repeat(F.lit(0), size + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))

    def moved(terms: Column, codes: Column) -> Column:
        def bump(acc: Column, code: Column, by: int) -> tuple[Column, Column]:
            count = acc["n"][code]
            return F.transform(acc["n"], lambda c, k: F.when(k == code, c + by).otherwise(c)), acc["s"] + terms[count + by] - terms[count]

        def step(acc: Column, at: Column) -> Column:
            def added(a: Column) -> Column:
                n, s = bump(a, codes[at], 1)
                return F.struct(n.alias("n"), s.alias("s"), a["low"].alias("low"))

            def removed(a: Column) -> Column:
                n, s = bump(a, codes[at - width], -1)
                return F.struct(n.alias("n"), s.alias("s"), a["low"].alias("low"))

            def noted(a: Column) -> Column:
                return F.struct(a["n"].alias("n"), a["s"].alias("s"), F.when(at >= width - 1, F.least(a["low"], a["s"])).otherwise(a["low"]).alias("low"))

            return let(F.when(at >= width, let(acc, removed)).otherwise(acc), lambda a: let(added(a), noted))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.lit(math.log2(width)) - acc["low"] / width)

    codes = F.transform(F.array_remove(F.split(value, ""), ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return let(term, lambda terms: let(codes, lambda k: moved(terms, k)))




def find_secrets(
    df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), width: int = 20, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = WHOLLY_ALLOWED
) -> DataFrame:
    """All secret spans of each whole text.

    Adds ``base`` and ``spans``: arrays of (start, kind, end), sorted, in code points with the end exclusive; ``kind``
    counts from 0 in the order assign, access, hex, entropy, and ``base`` holds the first three. An entropy span is a
    string of 20 or more of ``ALPHABET``, or what base spans leave of one, that no ``allowed`` pattern fits and one of
    whose windows of ``width`` characters reaches the bits of its character class. Marks where a string was cut belong
    to the span but aren't tested. Null and empty texts have no spans. Long texts with many spans cost in proportion.
    Repeated rows give repeated rows, an empty table an empty one; columns outside ``keep`` and those named like a result
    are dropped.
    """
    text = F.coalesce(F.col("__t"), F.lit(""))
    kept = [c for c in dict.fromkeys(keep) if c not in ("base", "spans")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__t"))

    def long_enough(least: int):
        return lambda s: F.char_length(s["value"]) >= least

    by_kind = [F.filter(located(text, p, g, k), long_enough(least)) for k, (_, p, g, least) in enumerate(BASE)]
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "__t", F.sort_array(F.transform(F.concat(*by_kind), place)).alias("base"))

    def random(s: Column) -> Column:
        v = s["value"]
        least = F.lit(math.inf)
        for c in reversed(classes):
            least = F.when(v.rlike(c.members), F.lit(c.bits)).otherwise(least)
        suspect = F.lit(True)
        for pattern in allowed:
            suspect = suspect & ~v.rlike(pattern)
        return F.when(suspect, window_entropy(v, width) >= least).otherwise(F.lit(False))

    # a candidate must mix letters and digits to matter: texts without such a run are passed over
    mixed = r"[A-Za-z+/_=-][0-9]|[0-9][A-Za-z+/_=-]"
    stripped = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.regexp_replace(s["value"], r"^[+/_=-]+|[+/_=-]+$", "").alias("value"))
    base = F.col("base")
    # what base spans leave of a candidate borders on their mask; marks where it was cut aren't tested
    masked = let(replaced(text, base, MASK, keep_length=True), lambda t: F.concat(located(t, WHOLE, 0, len(BASE)), F.filter(F.transform(located(t, CUT, 0, len(BASE)), stripped), long_enough(width))))
    every = F.when(F.size(base) > 0, masked).otherwise(located(text, CANDIDATE, 0, len(BASE)))
    found = F.when(text.rlike(mixed), F.filter(every, random)).otherwise(F.array().cast(SPOTS))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "base", F.sort_array(F.concat("base", F.transform(found, place))).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(n) for n in (*(k for k, *_ in BASE), ENTROPY)])
    return F.array_join(let(names, lambda n: F.transform(spans, lambda s: F.concat_ws(":", n[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))), ",")


def secrets_report(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(*keep, *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def replaced(text: Column, spans: Column, mark: str, keep_length: bool = False) -> Column:
    """``text`` with every span (sorted) replaced by ``mark``, or by as many marks as it has characters; overlapping spans
    are one. The text is cut into characters once, so many spans in a long text cost no more than its length."""

    def of_spans(m: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            # the text since the last span's end, then the mark; a span that begins inside the last one adds what it has more
            gap = F.array_join(F.slice(m["chars"], F.get(m["reach"], i) + 1, F.greatest(s["start"] - F.get(m["reach"], i), F.lit(0))), "")
            if keep_length:
                return F.concat(gap, F.repeat(F.lit(mark), F.greatest(s["end"] - F.greatest(s["start"], F.get(m["reach"], i)), F.lit(0))))
            return F.when(s["start"] >= F.get(m["reach"], i), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

        last = F.greatest(F.element_at(m["reach"], -1), F.element_at(m["spans"], -1)["end"])
        return F.concat(F.array_join(F.transform(m["spans"], piece), ""), F.array_join(F.slice(m["chars"], last + 1, F.size(m["chars"])), ""))

    ends = F.transform(spans, lambda s: s["end"])
    # a text of n characters is cut by an empty pattern into n pieces and an empty rest
    chars = F.slice(F.split(text, ""), F.lit(1), F.char_length(text))
    whole = let(F.struct(spans.alias("spans"), chars.alias("chars"), before(ends, F.lit(0), lambda a, b: F.greatest(a, b)).alias("reach")), of_spans)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one. Null stays null."""
    return replaced(text, spans, mark)
