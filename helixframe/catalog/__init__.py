"""Registered queries: each operator applied to the given tables, with its SQL twin."""

from helixframe.catalog.base import REGISTRY, Tables  # noqa: F401
from helixframe.catalog import (  # noqa: F401
    sources,
    scalars,
    filters,
    joins,
    profiling,
    ranking,
    splitting,
    evaluation,
    comparison,
    learning,
    incremental,
)
