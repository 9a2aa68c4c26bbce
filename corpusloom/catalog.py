"""Registry of named queries: Spark builder and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that registers a builder of (spark, table folder) under ``name``."""

    def keep(fn):
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _load() -> None:
    """Import the modules that register queries."""
    from corpusloom.plans import aggregates, calibration, consensus, events, graphs, inference, mechanism, models, regression, reports, response, segmentation, sources, testsets, text, transitions, vectors  # noqa: F401


_load()
