"""Files and tables that Spark reads; nothing is opened by this process itself, so any store works that Spark knows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..flow import Flow


def read_parquet(spark: SparkSession, *paths: str, order_by: Any = None) -> Flow:
    return Flow.over(spark.read.parquet(*paths), order_by)


def read_orc(spark: SparkSession, *paths: str, order_by: Any = None) -> Flow:
    return Flow.over(spark.read.orc(list(paths)), order_by)


def read_json(spark: SparkSession, *paths: str, schema: str | T.StructType, order_by: Any = None) -> Flow:
    """``schema`` is asked for, as inferring it would read everything twice."""
    return Flow.over(spark.read.schema(schema).json(list(paths)), order_by)


def read_csv(spark: SparkSession, *paths: str, schema: str | T.StructType, header: bool = True, order_by: Any = None) -> Flow:
    return Flow.over(spark.read.schema(schema).csv(list(paths), header=header), order_by)


def of_table(spark: SparkSession, name: str, order_by: Any = None) -> Flow:
    return Flow.over(spark.table(name), order_by)
