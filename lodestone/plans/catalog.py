"""Catalog of registered queries and their SQL."""

from __future__ import annotations

from . import build, oracles


def queries() -> dict:
    return dict(build.REGISTRY)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
