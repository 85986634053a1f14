"""Registered queries: every operator applied to the test tables, with its checking SQL."""

from __future__ import annotations

import importlib

MODULES = ["text_index", "search", "dense_eval", "ingestion", "citation", "relational"]


def _load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.common")


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
