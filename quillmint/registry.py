"""The library's queries by name, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with a list QUERIES of (name, query, SQL or None).
MODULES: tuple[str, ...] = ("quillmint.plans.spend", "quillmint.plans.matching", "quillmint.plans.activity", "quillmint.plans.expressions", "quillmint.plans.review", "quillmint.plans.tax", "quillmint.plans.coding", "quillmint.plans.lookup", "quillmint.plans.capture", "quillmint.plans.orders", "quillmint.plans.duties", "quillmint.plans.changes", "quillmint.plans.printed", "quillmint.streaming.autonomy")


def _entries() -> Iterator[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]]:
    for name in MODULES:
        yield from import_module(name).QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}
