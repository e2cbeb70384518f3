"""Operators for training-data pipelines; nothing else in the library imports them."""

from importlib import import_module

#: The modules that register queries.
MODULES = ("quality_rules", "near_dedup", "bpe", "decontaminate", "language_id", "url_filter", "secrets", "chat", "rule_ensemble", "pii")


def _gathered(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found.update(getattr(import_module(f"{__name__}.{m}"), name))
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
