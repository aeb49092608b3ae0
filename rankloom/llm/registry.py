"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("arrivals", "lookalike", "canonical", "variants", "formats", "tokens", "mixing", "subjects")


def _of(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f".{m}", __package__), name)
    return out


def queries() -> dict:
    return _of("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _of("SQL")
