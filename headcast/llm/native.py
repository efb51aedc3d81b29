"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` (or its lambdas) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space of the word definition: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")
