"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from authorloom.plans.catalogue import (  # noqa: F401
    analytics,
    cleaning,
    experiments,
    ingest,
    labels,
    media,
    stored,
    words,
)
from authorloom.plans.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
