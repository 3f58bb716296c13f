"""Wrappers that keep user functions vectorised."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F


def scalar(f: Callable[..., pd.Series], returns: str) -> Any:
    """A function of pandas Series to one as long, for use among Columns."""
    def typed(*x: pd.Series) -> pd.Series:
        return f(*x)

    return F.pandas_udf(typed, returns)


def grouped(f: Callable[..., Any], returns: str) -> Any:
    """A function of pandas Series to a value, for use as an aggregate; a group is in memory at once."""
    def typed(*x: pd.Series) -> Any:
        return f(*x)

    return F.pandas_udf(typed, returns)


def table(cls: type, returns: str) -> Any:
    """A Python table function (eval yields rows)."""
    return F.udtf(cls, returnType=returns)
