"""Views, composite jobs and the registered queries."""

from . import bands_queries, cards_queries, job_queries, label_queries, layout_queries, near_queries, quality_queries, resolve_queries, scalar_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
