"""Collects the queries and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.tables import CTES, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefix `body` with the shared table expressions it names, and those they name."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(definition)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, flags=re.IGNORECASE)
    shared = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    recursive = "RECURSIVE " if own and own.group(1) else ""
    return f"WITH {recursive}{shared}" + (f",\n{body[own.end():]}" if own else f"\n{body}")


def check(name: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent statement over the same tables."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = with_ctes(sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
