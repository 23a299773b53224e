"""Registry of queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where a table is dealt by a key, and the most partitions that Spark writes without holding a task's rows in memory.
SHARE, UNHELD = 250_000, 200

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows of a table dealt by a key, so that what follows needs no shuffle on it: the number of tasks grows with the rows, so that the
    memory of a task doesn't. Rows of one key meet in one task."""
    rows = df.count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(UNHELD, -(-rows // SHARE)), -(-rows // (8 * SHARE))), *by)
