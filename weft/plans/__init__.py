"""Registered queries, each a graph build, and their SQL counterparts."""

from weft.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
