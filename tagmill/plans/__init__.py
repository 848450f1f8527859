"""Registered queries: each has a Spark plan and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Item:
    """One query: what runs it on Spark, and the SQL that must give the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def registry() -> dict[str, Item]:
    """All queries of the package outside ``llm``."""
    from tagmill.plans import assembly, building, builds, bundles, corpus, decoding, edges, files, flows, labels, recognition, records, reports, sampling, strings, targets, text, variants

    found: dict[str, Item] = {}
    for module in (recognition, text, corpus, labels, records, building, edges, targets, strings, assembly, sampling, reports, files, decoding, flows, bundles, builds, variants):
        found |= module.ITEMS
    return found
