"""Joins in time and along preference ladders, as equi-joins on bins with the exact predicate behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 as a double, for timestamps with or without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: Column, at_right: Column, low: float, high: float, how: str = "inner") -> DataFrame:
    """Pairs with equal ``keys`` and ``low <= at_right - at_left <= high`` (seconds).

    The left row goes into each time bin that its band touches, at most two, and meets the right rows of that bin by
    equi-join; the exact predicate follows. Bins are as wide as the band, so a key's rows spread over its whole history
    and no bin holds more than its own stretch of time. Key columns appear once; left and right must not share others.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("band joins are inner or left_semi; keep unmatched rows by joining back on the left row's key")
    width = max(high - low, 1.0)
    binned_left = left.withColumn("__at", at_left).withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__at") + low) / width), F.floor((F.col("__at") + high) / width))))
    binned_right = right.withColumn("__rat", at_right).withColumn("__rbin", F.floor(F.col("__rat") / width))
    for k in keys:
        binned_right = binned_right.withColumnRenamed(k, f"__r_{k}")
    gap = F.col("__rat") - F.col("__at")
    on = (F.col("__bin") == F.col("__rbin")) & gap.between(low, high)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    joined = binned_left.join(binned_right, on, how)
    return joined.drop("__at", "__bin", "__rat", "__rbin", *[f"__r_{k}" for k in keys])


def latest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``; one aggregate, no sort of whole groups."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("__row")).select("__row.*")


def newest_set(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows of each key's newest ``at``. The maximum is aggregated ahead of the exchange and joined back."""
    top = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(at).alias("__top"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(top, [*on, F.col(at) == F.col("__top")]).select(*df.columns)


def next_items(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: Column, at_right: Column, horizon: float | None, first: int, parts: int | None = None) -> DataFrame:
    """``left`` with ``next``: the ``first`` right rows at or after its time, as an ordered array of structs (``at``, columns).

    Both sides go through one sorted stream per key, newest first, that carries the following right rows along: pairs are
    never made, however dense the right side is. With a ``horizon`` (seconds) a key's history is cut into bins of that
    length, right rows being given to their own bin and the one before; without, a key is one stream. Left rows without
    a following row have a null ``next``; so have those with a null key. With ``parts`` the streams are dealt over so many tasks.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    item = F.struct(at_right.alias("at"), *values)
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    coming = right.where(some & at_right.isNotNull()).select(*keys, item.alias("item"))
    bins = F.array(F.lit(0)) if horizon is None else F.array(F.floor(F.col("item.at") / horizon), F.floor(F.col("item.at") / horizon) - 1)
    ahead = Window.partitionBy(*keys, "bin").orderBy("item").rowsBetween(0, first - 1)
    coming = coming.withColumn("bin", F.explode(bins.cast("array<bigint>"))).select(*keys, "bin", F.col("item.at").alias("t"), "item", F.collect_list("item").over(ahead).alias("next"))
    place = F.lit(0) if horizon is None else F.floor(at_left / horizon)
    asked = left.select(*keys, place.cast("bigint").alias("bin"), at_left.alias("t"), F.struct(*left.columns).alias("row"))
    both = coming.unionByName(asked, allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *keys, "bin")
    # at equal times right rows come first, the least of them last
    back = Window.partitionBy(*keys, "bin").orderBy(F.col("t").desc(), F.col("row").isNull().desc(), F.col("item").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("near", F.last("next", ignorenulls=True).over(back)).where("row is not null")
    near = F.col("near") if horizon is None else F.filter("near", lambda x: x["at"] - F.col("t") <= horizon)
    found = met.select("row.*", F.when(some, near).alias("next"))
    return found.withColumn("next", F.when(F.size("next") > 0, F.col("next")))


def forward_asof(
    left: DataFrame, right: DataFrame, id_col: str, keys: Sequence[str], at_left: Column, at_right: Column, horizon: float | None, first: int = 1, parts: int | None = None
) -> DataFrame:
    """For each left row the ``first`` right rows at or after its time, within ``horizon`` seconds, in order (``nth``)."""
    values = [c for c in right.columns if c not in keys]
    each = next_items(left, right, keys, at_left, at_right, horizon, first, parts).select(*left.columns, F.posexplode("next").alias("nth", "item"))
    return each.select(*left.columns, *[F.col(f"item.{c}").alias(c) for c in values], (F.col("nth") + 1).alias("nth"))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: Column, at_right: Column, within: float, tie: str) -> DataFrame:
    """``left`` with ``nearest``: of the right rows of its key within ``within`` seconds the one nearest in time (``gap_s``, columns),
    of equally near ones that with the least ``tie``; rows without one aren't returned.

    Both sides go once through a sorted stream per key and stretch of time, forwards and backwards, that carries the last
    right row along: pairs are never made. Null keys and times meet nothing.
    """
    keys, width = list(keys), 2 * within + 1
    values = [c for c in right.columns if c not in (*keys, tie)]
    some = at_right.isNotNull()
    for k in keys:
        some = some & F.col(k).isNotNull()
    own = F.floor(F.col("__t") / width)
    coming = right.where(some).select(*keys, at_right.alias("__t"), F.struct(at_right.alias("at"), tie, *values).alias("__item")).withColumn("__bin", F.explode(F.array(own, own - 1)))
    asked = left.select(*keys, at_left.alias("__t"), F.struct(*left.columns).alias("__row"), F.floor((at_left - within) / width).alias("__bin"))
    stretch = Window.partitionBy(*keys, "__bin")
    # at equal times right rows come first, that with the least tie last
    among = (F.col("__row").isNotNull(), F.col(f"__item.{tie}").desc())
    last = lambda t: F.last("__item", ignorenulls=True).over(stretch.orderBy(t, *among).rowsBetween(Window.unboundedPreceding, 0))
    met = coming.unionByName(asked, allowMissingColumns=True).withColumn("__before", last(F.col("__t"))).withColumn("__after", last(F.col("__t").desc())).where("__row is not null")
    gap = lambda item: F.abs(item["at"] - F.col("__t"))
    candidate = lambda c: F.when(gap(F.col(c)) <= within, F.struct(gap(F.col(c)).alias("gap_s"), F.col(c)[tie].alias(tie), *[F.col(c)[v].alias(v) for v in values]))
    return met.select("__row.*", F.array_min(F.array(candidate("__before"), candidate("__after"))).alias("nearest")).where("nearest is not null")


def anti_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose keys, nulls equal to nulls, don't occur on the right."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return left.join(other, on, "left_anti")


def ladder(rows: DataFrame, cells: DataFrame, rungs: Sequence[Sequence[str]], value_cols: Sequence[str], least: int = 20) -> DataFrame:
    """The values of the most specific cell with at least ``least`` rows behind it, and the ``rung`` that gave them.

    ``cells`` holds, for each rung, cells keyed by the rung's columns (others null) with ``rung``, ``n`` and values.
    """
    out = rows
    for i, keys in enumerate(rungs):
        rung = cells.where((F.col("rung") == i) & (F.col("n") >= least)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*value_cols).alias(f"__v{i}"))
        if not keys:
            # the rung of all rows is one cell: an aggregate without keys gives one row, so it is broadcast as such
            out = out.crossJoin(F.broadcast(rung.agg(F.first(f"__v{i}").alias(f"__v{i}"))))
            continue
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        out = out.join(rung, on, "left").drop(*[f"__{k}" for k in keys])
    got = F.coalesce(*[F.col(f"__v{i}") for i in range(len(rungs))])
    which = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), i) for i in range(len(rungs))])
    return out.withColumns({"rung": which, **{c: got[c] for c in value_cols}}).drop(*[f"__v{i}" for i in range(len(rungs))])


def pooled_cells(rows: DataFrame, rungs: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates for every rung of a ladder in one pass over the rows (grouping sets); unused keys are null."""
    every = list(dict.fromkeys(k for r in rungs for k in r))
    out = rows.groupingSets([[F.col(k) for k in r] for r in rungs], *[F.col(k) for k in every]).agg(*aggregates, F.grouping_id().alias("__g"))
    mark = F.lit(None).cast("int")
    for i, r in enumerate(rungs):
        bits = sum((k not in r) << (len(every) - 1 - j) for j, k in enumerate(every))
        mark = F.when(F.col("__g") == bits, i).otherwise(mark)
    return out.withColumn("rung", mark).drop("__g")


def quantiles_by_counts(rows: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Per key ``n`` and ``q0``, ``q1`` ...: quantiles with linear interpolation, as ``percentile`` gives them.

    Values are counted first, ahead of the exchange, and the counts summed up in a sorted stream that can spill; no task
    holds the distinct values of a key, as an exact percentile's buffer does.
    """
    return quantiles_by_weights(rows.groupBy(*keys, value).agg(F.count("*").alias("__n")), keys, value, "__n", levels)


def pooled_quantiles(rows: DataFrame, rungs: Sequence[Sequence[str]], value: str, levels: Sequence[float]) -> DataFrame:
    """``quantiles_by_counts`` for every rung of a ladder, with ``rung``; unused keys are null."""
    every = list(dict.fromkeys(k for r in rungs for k in r))
    cell = lambda i, r: F.struct(F.lit(i).alias("rung"), *[(F.col(k) if k in r else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in every])
    counted = rows.groupBy(*every, value).agg(F.count("*").alias("__n"))
    return quantiles_by_weights(counted.select(F.explode(F.array(*[cell(i, r) for i, r in enumerate(rungs)])).alias("c"), value, "__n").select("c.*", value, "__n"), ["rung", *every], value, "__n", levels)


def quantiles_by_weights(rows: DataFrame, keys: Sequence[str], value: str, weight: str, levels: Sequence[float]) -> DataFrame:
    """``quantiles_by_counts`` of rows that stand for ``weight`` equal ones each."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("n"))
    whole = Window.partitionBy(*keys)
    summed = counts.withColumn("below", F.sum("n").over(whole.orderBy(value))).withColumn("all", F.sum("n").over(whole))
    at = {q: (F.col("all") - 1) * q for q in levels}
    edge = lambda rank: F.min(F.when(F.col("below") > rank, F.col(value)))
    by = summed.groupBy(*keys).agg(F.max("all").alias("n"), *[e for i, q in enumerate(levels) for e in (edge(F.floor(at[q])).alias(f"__lo{i}"), edge(F.ceil(at[q])).alias(f"__hi{i}"))])
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return by.select(*keys, "n", *[(F.col(f"__lo{i}") + part(q) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}") for i, q in enumerate(levels)])


def trailing(rows: DataFrame, keys: Sequence[str], at: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over the rows of their key in the ``seconds`` up to each, itself included.

    ``at`` is whole seconds. A key's history is cut into stretches of ``seconds``; a row counts in its own and in the
    next, so a window never spans more than two of them and a busy key is spread over its history.
    """
    stretch = F.floor(F.col(at) / seconds)
    both = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__bin", stretch + F.when(F.col("__own"), 0).otherwise(1))
    window = Window.partitionBy(*keys, "__bin").orderBy(at).rangeBetween(-seconds, 0)
    return both.withColumns({name: value.over(window) for name, value in aggregates.items()}).where("__own").drop("__own", "__bin")


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: Column, at_right: Column) -> DataFrame:
    """``left`` with ``latest``: the newest right row (``at``, columns) of its key at or before its time; null if none.

    Both sides go through one sorted stream per key that carries the last right row along. Of right rows at one time the
    greatest counts. Null keys meet nothing.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    known = right.where(some & at_right.isNotNull()).select(*keys, at_right.alias("t"), F.struct(at_right.alias("at"), *values).alias("item"))
    both = known.unionByName(left.select(*keys, at_left.alias("t"), F.struct(*left.columns).alias("row")), allowMissingColumns=True)
    sofar = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("row").isNotNull(), F.col("item")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("latest", F.last("item", ignorenulls=True).over(sofar)).where("row is not null")
    return met.select("row.*", F.when(some, F.col("latest")).alias("latest"))
