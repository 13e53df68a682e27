"""All queries of the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import histograms, large, models, motion, series, structures, surfaces, transforms, weighing

_PLANS = (histograms, transforms, series, models, structures, surfaces, weighing, motion, large)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _PLANS for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _PLANS for k, q in m.SQL.items()}
