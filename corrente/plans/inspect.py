"""What a plan does, for tests and for a look before a large run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, from the top."""
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", physical(df), re.M)


def exchanges(df: DataFrame) -> int:
    return sum(x in ("Exchange", "BroadcastExchange") for x in operators(df))


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df)))


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the file scans read."""
    return {x.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", physical(df)) for x in s.split(",") if x}
