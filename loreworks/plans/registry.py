"""Registry of named queries: a Spark job over the test tables and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreworks.plans import tables as tb
from loreworks.session import ship_package

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t("docs")`` gives a derived table as a DataFrame.

    ``sql`` is the body of the twin; the derived tables named in ``needs`` become its CTEs.
    """

    def wrap(fn: Callable[[tb.Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            # stamps without a zone are UTC everywhere in these tables
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(tb.Tables(spark, sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = tb.with_tables(needs.split(), sql)
        return fn

    return wrap


def load_all() -> None:
    from loreworks.plans import (  # noqa: F401
        corpus_queries,
        event_queries,
        evaluation_queries,
        graph_queries,
        memory_queries,
        policy_queries,
        project_queries,
        retrieval_queries,
        source_queries,
        stream_queries,
        task_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(_QUERIES)


def twins() -> dict[str, str]:
    load_all()
    return dict(_SQL)
