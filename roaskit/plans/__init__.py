"""Whole queries: operators put together over the given tables, with their checking SQL."""

from __future__ import annotations


def load_queries() -> dict:
    """All registered queries by name."""
    from roaskit.plans import queries_business, queries_forecast, queries_ingest  # noqa: F401
    from roaskit.plans.catalog import REGISTRY
    return REGISTRY
