"""All registered queries; importing a section registers it."""

from __future__ import annotations

from ridegauge.catalog.base import ORACLES, QUERIES

SECTIONS = ("cleaning", "geography", "series", "stations", "forecasting", "warehouse", "models")


def _load() -> None:
    from importlib import import_module

    for section in SECTIONS:
        import_module(f"ridegauge.catalog.{section}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
