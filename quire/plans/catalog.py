"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import checks, formats, nested, outputs, pages, structure, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (nested, structure, texts, checks, formats, outputs, pages)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
