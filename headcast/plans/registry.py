"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headcast.plans import arrivals, bodies, calibration, estimates, lifecycle, payloads, predictions, reports, stores, streams, trainings

FAMILIES = (calibration, arrivals, predictions, estimates, reports, lifecycle, payloads, bodies, streams, stores, trainings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.ORACLE.items()}
