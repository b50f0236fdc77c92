"""Queries over the sample tables, each next to the SQL that states its expected result."""

from __future__ import annotations

from leverwise.plans.registered import analysis, catalogue, graph, hierarchy, ingest, overlay, refused, registry, security, stored

AREAS = (overlay, security, catalogue, analysis, hierarchy, graph, ingest, registry, stored, refused)


def all_queries() -> dict:
    """Name -> (function of the table bundle, expected-result SQL or None)."""
    found: dict = {}
    for area in AREAS:
        found.update(area.QUERIES)
    return found
