"""The runnable queries by name, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from costbook.sources.bindings import Tables, with_bindings


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Adds a query; without SQL it is checked by a test on a small hand-made frame."""

    def keep(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return keep


def oracle(name: str) -> str | None:
    sql = REGISTRY[name].sql
    return None if sql is None else with_bindings(sql)
