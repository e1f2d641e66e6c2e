"""Queries by name, and the SQL that states what each must return."""

from __future__ import annotations

from . import catalog_metrics, catalog_search, catalog_vault


def queries() -> dict:
    return catalog_search.QUERIES | catalog_vault.QUERIES | catalog_metrics.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog_search.SQL | catalog_vault.SQL | catalog_metrics.SQL
