"""The queries by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with the SQL that gives the same rows if there is any."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


# the modules below register their queries when they are imported
from geostrata.plans import header_queries, model_queries, plane_queries, source_queries, trace_queries  # noqa: E402, F401
