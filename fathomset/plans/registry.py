"""The list of registered queries: name → (Spark callable, survey ids, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Entry(fn, covers, sql)
        return fn
    return register
