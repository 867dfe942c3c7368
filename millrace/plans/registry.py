"""Named queries over the test tables, and the SQL that states the same results.

Names begin with the operator's id in the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, its oracle."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


from millrace.plans import curation_queries, log_queries, retrieval_queries, row_queries, service_queries, text_queries  # noqa: E402, F401  they register themselves
