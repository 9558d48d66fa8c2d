"""All queries of the core."""

from __future__ import annotations

from importlib import import_module

MODULES = ["incremental", "history", "quality", "text", "clones", "graphs", "code", "mutation", "details"]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"codelens.plans.{m}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"two queries are named {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
