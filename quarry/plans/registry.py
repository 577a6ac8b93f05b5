"""Every registered query of the library: name -> (spark, sf_dir) -> DataFrame, and its SQL."""

from __future__ import annotations

from quarry.plans import analytics, catalog, corpus, curation, evaluation, retrieval, scans, streams, sync, verdicts  # noqa: F401
from quarry.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
