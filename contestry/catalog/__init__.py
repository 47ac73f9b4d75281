"""Registered queries by name, and the oracle SQL of those that SQL can express."""

from importlib import import_module

_MODULES = ("records", "features", "evaluation", "ingest", "models", "services")


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"contestry.catalog.{name}"), attr)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("Q")


def all_sql() -> dict:
    return _merged("SQL")
