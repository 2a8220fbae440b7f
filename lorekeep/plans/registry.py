"""Registry of named queries over the sample tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from lorekeep.sources import sample
from lorekeep.sources.catalog import SampleCatalog

Build = Callable[[SampleCatalog], DataFrame]


class Query(NamedTuple):
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build(catalog)``; ``sql`` may use ``@table`` for wiki and sample tables."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sample.oracle(sql) if sql else None)
        return build

    return register
