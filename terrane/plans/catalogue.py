"""Registry of the layer, tile and catalogue queries with their SQL."""

from __future__ import annotations

from terrane.plans import containers, layers, tables, tiles

PARTS = (layers, tiles, tables, containers)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
