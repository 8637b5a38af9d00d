"""Every core query by name, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenaria.plans import activity, ballots, chamber, composite, formats, history, phrases, records, views

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that hold ``QUERIES`` and ``SQL``.
MODULES: tuple = (history, phrases, ballots, chamber, activity, views, records, formats, composite)

FLAGSHIP = "x3_smoothed_ratio"


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
