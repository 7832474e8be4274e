"""Registered queries, by family."""

from __future__ import annotations


def _load():
    from marginalia.plans import base
    from marginalia.plans import budgets, intake, logs, matching, search, streams, structure, texts  # noqa: F401
    return base


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLES)
