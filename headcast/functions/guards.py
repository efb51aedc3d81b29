"""Predicates that say what an unknown value means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def optional(column: Column, wanted) -> Column:
    """Equal to ``wanted``; anything goes if nothing is wanted."""
    return F.lit(True) if wanted is None else column == wanted


def same_or_empty(a: Column, b: Column) -> Column:
    """Equal texts, unknown counting as empty."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def known_false(flag: Column) -> Column:
    """False or unknown."""
    return ~F.coalesce(flag, F.lit(False))


def towards(direction: Column, target: str | None) -> Column:
    """The target direction in any case; an empty or missing target keeps all, unknown directions too."""
    return F.lit(True) if not target else F.coalesce(F.lower(direction) == target.lower(), F.lit(False))


def finite(number: Column) -> Column:
    """A known number that is neither infinite nor none."""
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def heads_for(lat1: Column, lon1: Column, lat2: Column, lon2: Column, to_lat: Column, to_lon: Column) -> Column:
    """Whether the way from 1 to 2 and the way from 1 to the destination point the same way (positive dot product)."""
    return (lat2 - lat1) * (to_lat - lat1) + (lon2 - lon1) * (to_lon - lon1) > 0
