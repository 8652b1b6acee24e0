"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from vecspark.catalog.registry import ORACLE, QUERIES  # noqa: F401
from vecspark.catalog import (  # noqa: F401  (registration)
    clusters, search, sources, stats, streams, texts, vectors)
