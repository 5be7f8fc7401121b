"""All registered queries."""

from trialweave.catalog import analysis_queries, cohort_queries, imputation_queries  # noqa: F401
from trialweave.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
