"""All queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from stratacell.plans import cells, estimates, harvest, keying, records, relations, reports, resampled, reviews, streams, surface, texts  # noqa: F401
from stratacell.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "under_reporting_by_lang"
