"""Quality statistics of texts, and robust outliers among them. Column expressions and aggregates only.

Within each language and source, a minimum-covariance-determinant estimate says what ordinary statistic vectors look
like: from several starts, keep the half of the vectors nearest to the centre, take their mean and covariance, repeat until
nothing changes, and take the start that ends with the least determinant. Equal vectors count once, so that copies don't
make a pattern. Estimates are drawn towards those of the language, and these towards the whole table's, the more the fewer
vectors stand behind them. Vectors far from their estimate by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.checkpoints import cut
from headcast.llm.native import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics are kept as whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 4096


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words whose content occurs twice or more.

    Windows are compared by a 64-bit hash. Most texts repeat none, which a set of the hashes tells; else the hashes
    are sorted with their places, and the places of equal neighbours are counted without counting a word twice.
    """

    def of_windows(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def again(e: Column, i: Column) -> Column:
                before = (i > 0) & (F.get(s, i - 1)["h"] == e["h"])
                after = (i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == e["h"])
                return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), e["at"]).otherwise(F.lit(-1))

            places = F.sort_array(F.filter(F.transform(s, again), lambda p: p >= 0))
            start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")), lambda a: a["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def add_base_statistics(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the five base statistics of each whole text, as longs; a null text has no words."""
    text = F.coalesce(F.col("__t"), F.lit(""))
    kept = [c for c in dict.fromkeys(keep) if c not in BASE_COLUMNS]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__t"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        of_words.alias("__w"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
    ).select(*[F.col(f"`{c}`") for c in kept], F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__w.again").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class OutlierRule:
    """``support``: share of a group's vectors that the estimate rests on. ``steps``: most concentration steps, should
    they not settle before. ``prior``: so many vectors does the wider group's estimate count for in the narrower one's.
    ``cutoff``: squared Mahalanobis distance beyond which a vector is rejected, a quantile of chi-square with as many
    degrees as statistics. ``floor``: least standard deviation of each transformed statistic, below which a difference
    means nothing (most texts have no symbol, so the raw scatter is often nil)."""

    support: float = 0.5
    steps: int = 12
    prior: int = 50
    cutoff: float = 18.467
    floor: tuple[float, ...] = (0.05, 0.15, 0.15, 0.10)


def statistic_vector() -> list[Column]:
    """Logarithms of word length and of the shares of symbols, repeated lines and repeated words.

    Each share is drawn towards the ordinary by some added words, so that short texts don't scatter more than long ones.
    """
    n = F.col("n_words")
    values = [
        F.log((F.col("word_chars") + 300.0) / (n + 60.0)),
        F.log1p(20.0 * F.col("n_symbols") / (F.col("word_chars") + 400.0)),
        F.log1p(20.0 * F.col("n_dup_lines") / (n + 100.0)),
        F.log1p(5.0 * F.col("n_repeat_words") / (n + 100.0)),
    ]
    return [F.round(v * SCALE).cast("long") for v in values]


def distance(x: Sequence[Column], mean: Sequence[Column], cov: Sequence[Sequence[Column]]) -> tuple[list[tuple[str, Column]], Column]:
    """Named intermediate columns (an LDL' factorisation of ``cov``, row by row) and the squared distance over them."""
    p, made = len(x), []
    name = lambda kind, *ij: f"__{kind}{''.join(map(str, ij))}"
    for j in range(p):
        d = cov[j][j]
        for k in range(j):
            d = d - F.col(name("l", j, k)) * F.col(name("l", j, k)) * F.col(name("d", k))
        made.append((name("d", j), d))
        for i in range(j + 1, p):
            v = cov[i][j]
            for k in range(j):
                v = v - F.col(name("l", i, k)) * F.col(name("l", j, k)) * F.col(name("d", k))
            made.append((name("l", i, j), v / F.col(name("d", j))))
    for i in range(p):
        z = x[i] - mean[i]
        for k in range(i):
            z = z - F.col(name("l", i, k)) * F.col(name("z", k))
        made.append((name("z", i), z))
    total = F.lit(0.0)
    for i in range(p):
        total = total + F.col(name("z", i)) * F.col(name("z", i)) / F.col(name("d", i))
    return made, total


def _with(df: DataFrame, made: Sequence[tuple[str, Column]]) -> DataFrame:
    for name, value in made:
        df = df.withColumn(name, value)
    return df


def _quantile_bins(rows: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Per group and share (``q0``, ``q1`` ...) the least whole ``value`` that this share of its rows don't exceed; ``n``.

    Rows are counted by value first (aggregated before the exchange), then counts are summed up in order.
    """
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*group).orderBy(value)
    summed = counts.withColumn("below", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    least = [F.min(F.when(F.col("below") >= F.ceil(F.col("all") * q), F.col(value))).alias(f"q{i}") for i, q in enumerate(shares)]
    return summed.groupBy(*group).agg(*least, F.max("all").alias("n"))


def consistency(support: float) -> float:
    """How much too small the covariance of the nearest share of a four-dimensional normal is.

    The share over the mass of chi-square with two degrees more, up to the quantile of four degrees; both distribution
    functions have closed forms.
    """
    low, high = 0.0, 100.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < support else (low, x)
    return support / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


LEVEL = ["level", "a", "b"]


def levelled(vectors: DataFrame) -> DataFrame:
    """Each vector in its language and source (level 0), its language (1) and the whole table (2)."""
    group = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("a"), b.alias("b"))
    none = F.lit("")
    levels = F.array(group(0, F.col("g_lang"), F.col("g_source")), group(1, F.col("g_lang"), none), group(2, none, none))
    return vectors.select(F.explode(levels).alias("g"), *X).select("g.*", *X)


def mcd_estimates(rows: DataFrame, key: Sequence[str], rule: OutlierRule, few: bool) -> DataFrame:
    """One row per group: ``n`` vectors, ``m0..`` (mean) and ``cij`` (consistent covariance plus the floor).

    Starts: the medians with the least scatter, the medians with the quartiles' scatter, and the lower quartiles with
    that scatter (junk mostly raises the statistics). All starts of all groups go through each step together.
    """
    p, key = len(X), list(key)
    floor = [(f * SCALE) ** 2 for f in rule.floor]
    each = rows.select(*key, F.posexplode(F.array(*X)).alias("__i", "__x"))
    at = lambda i, c: F.max(F.when(F.col("__i") == i, F.col(c)))
    spots = _quantile_bins(each, [*key, "__i"], "__x", (0.25, 0.5, 0.75)).groupBy(*key).agg(F.max("n").alias("n"), *[at(i, f"q{j}").cast("double").alias(f"q{i}{j}") for i in range(p) for j in range(3)])
    scatter = [F.pow((F.col(f"q{i}2") - F.col(f"q{i}0")) / 1.349, 2) + floor[i] for i in range(p)]

    def start(s: int, quantile: int, spread: Sequence[Column]) -> Column:
        places = [F.col(f"q{i}{quantile}").alias(f"m{i}") for i in range(p)]
        return F.struct(F.lit(s).alias("s"), *places, *[(spread[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)], F.lit(0).cast("long").alias("sig"))

    starts = F.array(start(0, 1, [F.lit(f) for f in floor]), start(1, 1, scatter), start(2, 0, scatter))
    now = cut(spots.select(*key, "n", F.inline(starts)))
    rows = rows.withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(3)])))
    scale, whole = consistency(rule.support), [*key, "s"]

    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    products = [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in pairs]
    sums = [f"s{i}" for i in range(p)] + [f"s{i}{j}" for i, j in pairs]
    for _ in range(rule.steps):
        placed = with_distance(rows, now, whole, X, few, ["sig"]).withColumn("bin", F.floor(F.least(F.log1p("d2"), F.lit(60.0)) * 256).cast("long"))
        # one pass: sums by distance bin, ahead of the exchange; then the bins of the nearest share are added up
        binned = placed.groupBy(*whole, "bin").agg(F.max("sig").alias("before"), F.count("*").alias("k"), *products)
        upto, group = Window.partitionBy(*whole).orderBy("bin"), Window.partitionBy(*whole)
        near = binned.withColumn("n", F.sum("k").over(group)).withColumn("below", F.sum("k").over(upto) - F.col("k")).where(F.col("below") < F.ceil(F.col("n") * rule.support))
        added = near.groupBy(*whole).agg(F.max("before").alias("before"), F.max("n").alias("n"), F.sum("k").alias("k"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in sums])
        mean = [F.col(f"s{i}").cast("double") / F.col("k") for i in range(p)]
        spread = {(i, j): F.col(f"s{i}{j}").cast("double") / F.col("k") - mean[i] * mean[j] for i, j in pairs}
        sig = F.xxhash64("k", *sums)
        now = cut(added.select(*whole, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(v * scale + (floor[i] if i == j else 0.0)).alias(f"c{i}{j}") for (i, j), v in spread.items()], sig.alias("sig"), (sig != F.col("before")).alias("moved")))
        if now.where("moved").isEmpty():
            break
    made, _ = distance([F.lit(0.0)] * p, [F.lit(0.0)] * p, [[F.col(f"c{max(i, j)}{min(i, j)}") for j in range(p)] for i in range(p)])
    scored = _with(now, [(name, value) for name, value in made if not name.startswith("__z")])
    size = F.round(sum(F.log(f"__d{i}") for i in range(p)), 9)
    kept = ["n", *[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i in range(p) for j in range(i + 1)]]
    return scored.groupBy(*key).agg(F.min_by(F.struct(*kept), F.struct(size, "s")).alias("e")).select(*key, "e.*")


def drawn_together(estimates: DataFrame, rule: OutlierRule, few: bool) -> DataFrame:
    """Level 0's estimates, drawn towards their language's, and these towards the whole table's: weight n / (n + prior)."""
    estimates = cut(estimates)
    values = [c for c in estimates.columns if c not in (*LEVEL, "n")]
    whole = estimates.where("level = 2").first()
    if whole is None:
        return estimates.select(F.col("a").alias("g_lang"), F.col("b").alias("g_source"), *values)
    weight = lambda n: F.col(n) / (F.col(n) + rule.prior)
    langs = estimates.where("level = 1").select(F.col("a"), *[(weight("n") * F.col(v) + (1 - weight("n")) * F.lit(whole[v])).alias(f"l_{v}") for v in values])
    own = estimates.where("level = 0").join(F.broadcast(langs) if few else langs, "a")
    return cut(own.select(F.col("a").alias("g_lang"), F.col("b").alias("g_source"), *[(weight("n") * F.col(v) + (1 - weight("n")) * F.col(f"l_{v}")).alias(v) for v in values]))


#: So many groups at most are broadcast; beyond, Spark joins them by exchange.
FEW_GROUPS = 200_000
GROUP = ["g_lang", "g_source"]
X = ["x0", "x1", "x2", "x3"]


def with_distance(rows: DataFrame, estimates: DataFrame, group: Sequence[str], x: Sequence[str], few: bool, more: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance from their group's estimate, and ``more`` columns of that."""
    p = len(x)
    e = estimates.select(*group, *[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i in range(p) for j in range(i + 1)], *more)
    joined = rows.join(F.broadcast(e) if few else e, list(group), "left")
    made, total = distance([F.col(c) for c in x], [F.col(f"m{i}") for i in range(p)], [[F.col(f"c{max(i, j)}{min(i, j)}") for j in range(p)] for i in range(p)])
    return _with(joined, made).withColumn("d2", total).select(*rows.columns, *more, "d2")


def measured(df: DataFrame, text_col: str, lang_col: str, source_col: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` (as ``k0``, ``k1`` ...), base statistics and verdict, group names and transformed statistics."""
    base = add_base_statistics(
        df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("g_lang"), F.col(f"`{source_col}`").cast("string").alias("g_source")),
        "text", [*[f"k{i}" for i in range(len(keep))], *GROUP],
    )
    # a null name can't be joined on: names get a mark that null lacks
    marks = {g: F.coalesce(F.concat(F.lit("="), g), F.lit("")) for g in GROUP}
    return base.withColumns({"base_failed": base_failed(), **dict(zip(X, statistic_vector())), **marks})


def fit(rows: DataFrame, rule: OutlierRule = OutlierRule()) -> tuple[DataFrame, bool]:
    """Estimates of all groups from ``measured`` rows, and whether they are few enough to broadcast."""
    vectors = cut(rows.where(~F.col("base_failed")).select(*GROUP, *X).distinct())
    few = vectors.select(*GROUP).distinct().count() <= FEW_GROUPS
    return drawn_together(mcd_estimates(levelled(vectors), LEVEL, rule, few), rule, few), few


def judged(rows: DataFrame, estimates: DataFrame, few: bool, rule: OutlierRule = OutlierRule()) -> DataFrame:
    """``measured`` rows with ``distance`` and ``kept``."""
    return with_distance(rows, estimates, GROUP, X, few).withColumns({
        "distance": F.when(~F.col("base_failed"), F.col("d2")),
        "kept": ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= rule.cutoff),
    })


def judge_quality(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: Sequence[str] = ("doc_id",), rule: OutlierRule = OutlierRule()
) -> DataFrame:
    """Base statistics and a verdict for each row.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long), ``base_failed``,
    ``distance`` (squared, from the group's estimate) and ``kept``: false if the base rules fail, else whether the
    distance is within the cutoff. Estimates rest on the different vectors of the rows that pass the base rules, at
    every size by one formula. Rows at equal distance are all in an estimate's support or all outside. Null languages
    and sources are groups of their own. Null texts have no words and fail; very long ones are measured whole. Repeated
    rows give repeated rows, an empty table an empty one; only ``keep`` is carried.
    """
    carried = [c for c in dict.fromkeys(keep) if c not in (*BASE_COLUMNS, "base_failed", "distance", "kept")]
    rows = cut(measured(df, text_col, lang_col, source_col, carried))
    estimates, few = fit(rows, rule)
    return judged(rows, estimates, few, rule).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carried)], *BASE_COLUMNS, "base_failed", "distance", "kept")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rule: OutlierRule = OutlierRule()) -> DataFrame:
    """The rows of ``df`` that ``judge_quality`` keeps, with all their columns.

    Estimates are fitted on narrow rows; the second pass over the texts measures again and filters in place, so that
    no text is exchanged.
    """
    estimates, few = fit(cut(measured(df, text_col, lang_col, source_col, ())), rule)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    return judged(measured(whole, "text", "lang", "source", ["row"]), estimates, few, rule).where("kept").select("k0.*")
