"""The engine's named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import code, corpus, dedup, ingest, learning, origins, outputs, records, relational, scores

ALL = code.QUERIES | corpus.QUERIES | dedup.QUERIES | ingest.QUERIES | learning.QUERIES | origins.QUERIES | outputs.QUERIES | records.QUERIES | relational.QUERIES | scores.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
