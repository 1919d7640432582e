"""Queries over the given tables, each with the same query in SQL."""

from lumberline.catalog import fields, lines, stats, streams, views, words  # noqa: F401  (they register themselves)
from lumberline.catalog.base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
