"""Imports every query module so that the registry is complete."""

from . import learn_queries, rule_queries, clean_queries, log_queries, table_queries, cluster_queries, compare_queries, stats_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
