"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from fiscalith.plans import chunking, derived_sql, ingest, linking, listing, policy, quality, quality_sql, registry, scalars, trends  # noqa: F401
from fiscalith.plans.registry import Query

QUERIES: dict[str, Query] = {**quality.QUERIES, **registry.QUERIES}
ORACLES: dict[str, str] = {**quality_sql.ORACLES, **registry.ORACLES, **derived_sql.ORACLES}
