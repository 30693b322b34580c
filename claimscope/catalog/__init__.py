"""Registered queries over the star-schema test tables, each with the SQL that checks it."""

from claimscope.catalog import aggregates, matching, models, reports, rows  # noqa: F401
from claimscope.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
