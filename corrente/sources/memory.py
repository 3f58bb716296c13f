"""In-memory rows; their order is that of the input."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..flow import Flow
from ..functions.rows import HIDDEN


def _schema(schema: str | T.DataType) -> T.StructType:
    """A lone type is that of a column ``value``."""
    if isinstance(schema, T.StructType):
        return schema
    kind = schema if isinstance(schema, T.DataType) else T.DataType.fromDDL(schema)
    return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])


def of_rows(spark: SparkSession, rows: Iterable[Any], schema: str | T.DataType) -> Flow:
    """Rows (tuples; plain values, if there is one column) with their places as order.  ``schema``: DDL such as "k int, v string", or a type alone such as "int" for a column ``value``."""
    kind = _schema(schema)
    lone = len(kind) == 1
    data = [(i, *((r,) if lone and not (isinstance(r, tuple) and len(r) == 1) else tuple(r))) for i, r in enumerate(rows)]
    full = T.StructType([T.StructField(f"{HIDDEN}0", T.LongType(), False), *kind.fields])
    return Flow(spark.createDataFrame(data, full), (True,))


def of_seq(spark: SparkSession, rows: Iterable[Any], schema: str | T.DataType) -> Flow:
    """Any iterable."""
    return of_rows(spark, rows, schema)


def of_seqs(spark: SparkSession, parts: Iterable[Flow | Iterable[Any]], schema: str | T.DataType) -> Flow:
    """All elements of several sequences or flows, without an order."""
    flows = [p if isinstance(p, Flow) else of_rows(spark, p, schema) for p in parts]
    if not flows:
        return empty(spark, schema).unordered()
    first, *more = (f.unordered() for f in flows)
    return first.concat(*more) if more else first


def empty(spark: SparkSession, schema: str | T.DataType) -> Flow:
    return of_rows(spark, [], schema)


def singleton(spark: SparkSession, row: Any, schema: str | T.DataType) -> Flow:
    return of_rows(spark, [row], schema)
