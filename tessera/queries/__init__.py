"""Registered queries over the star-schema tables, each with the SQL that an independent engine answers alike."""

from tessera.queries import agent, filed, grouped, joined, models, ordered, relational, stored, watched  # noqa: F401
from tessera.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
