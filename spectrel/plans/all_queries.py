"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("spectral_queries", "record_queries", "series_queries", "decision_queries", "table_queries", "audits")


def load() -> None:
    for m in MODULES:
        import_module(f"spectrel.plans.{m}")
