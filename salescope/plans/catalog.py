"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["sales_queries", "mapping_queries", "log_queries", "forecast_queries", "history_queries", "question_queries", "report_queries", "source_queries", "stream_queries"]


def _gather(attribute: str) -> dict:
    merged = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"salescope.plans.{name}"), attribute))
    return merged


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")
