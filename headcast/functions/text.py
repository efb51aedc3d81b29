"""Small words for values: directions, times, classes, sentences, batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compass(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Coarse direction from one point to another: along the axis on which they differ more, north and south on ties."""
    up, right = lat2 - lat1, lon2 - lon1
    return F.when(F.abs(up) >= F.abs(right), F.when(up >= 0, "northbound").otherwise("southbound")).otherwise(F.when(right >= 0, "eastbound").otherwise("westbound"))


def iso_of_millis(ms: Column) -> Column:
    """UTC time of milliseconds since 1970, to the millisecond."""
    return F.concat(F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def quality_bin(text: Column) -> Column:
    """Class of a data-quality text: the first of high, medium and low that it names, else any."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(w), w) for w in ("high", "medium", "low")], F.lit("any"))


def quality_of_score(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "medium").otherwise("low")


def minutes_text(seconds: Column) -> Column:
    """A wait in words: whole minutes, halves to the even one, ``1 minute`` without plural; null if unknown."""
    n = F.bround(seconds / 60).cast("bigint")
    return F.when(n <= 0, "due now").otherwise(F.concat(n.cast("string"), F.when(n == 1, " minute").otherwise(" minutes")))


def batches(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` elements, the last with what is left."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at, F.lit(size)))


def nearest_quantile(quantiles: Column, wanted: float) -> Column:
    """The value of the level nearest to ``wanted`` in a map from level to value; the lower level on ties."""
    levels = F.array_sort(F.map_keys(quantiles))
    best = F.aggregate(levels, F.lit(None).cast("double"), lambda a, q: F.when(a.isNull() | (F.abs(q - wanted) < F.abs(a - wanted)), q).otherwise(a))
    return F.element_at(quantiles, best)
