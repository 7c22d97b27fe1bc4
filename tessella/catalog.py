"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from tessella.plans import features, models, pipelines, preparation  # noqa: F401  each registers its queries
from tessella.plans.features import flagship
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
