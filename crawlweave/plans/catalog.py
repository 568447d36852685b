"""Imports every query module, so that the registry is complete."""

from crawlweave.plans import (  # noqa: F401
    q_metrics,
    q_pages,
    q_quality,
    q_sources,
    q_streams,
    q_tasks,
    q_text,
    q_urls,
)
from crawlweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
