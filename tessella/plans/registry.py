"""Registry of queries: a name, a plan over (spark, sf_dir), and the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        PLANS[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register driver tables as temporary views, for plans that are written in SQL."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def sql_query(name: str, spark_sql: str, oracle: str | None, *tables: str) -> None:
    """A plan that is one SQL statement over driver tables and inline fixtures."""

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(spark_sql)
