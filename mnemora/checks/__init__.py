"""Registered queries with the SQL they are compared with."""

from . import registry
from . import (  # noqa: F401  (importing registers)
    search,
    graph,
    ingestion,
    lifecycle,
    listing,
    profiles,
    reading,
    sharing,
    statistics,
    streams,
    texts,
    updates,
)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
