"""Importing this module registers all queries."""

from tidemark.queries import aggregates, composites, relational, scalars, sources  # noqa: F401
