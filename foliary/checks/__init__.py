"""Queries over the given tables, one per operator, with the SQL that must agree."""

from foliary.checks import jobs, relations, scans, values
from foliary.checks.base import ORACLE, QUERIES
from foliary.checks.jobs import flagship

__all__ = ["ORACLE", "QUERIES", "flagship", "jobs", "relations", "scans", "values"]
