"""Query registry of the reference's operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL if SQL can express it."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if oracle:
            _ORACLES[function.__name__] = oracle
        return function

    return add


def _load() -> None:
    importlib.import_module("loomwell.plans.reference_queries")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
