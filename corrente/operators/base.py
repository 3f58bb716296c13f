"""A DataFrame with a tracked order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any, Self

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import HIDDEN, Row, column
from ..plans import prefix


class NotFound(KeyError):
    """find and pick met no element that fits."""


class EmptyFlow(ValueError):
    """The operator has no result for an empty flow."""


class NoOrder(ValueError):
    """The operator is defined by an order, and the flow has none."""


@dataclass(frozen=True)
class Desc:
    """A descending order key: NULL last, NaN first."""

    key: Any


class Base:
    """Immutable.  ``directions``: for each hidden order column whether it ascends (NULL first, NaN last); None: no order.  ``skipped``: rows still to be dropped from the front."""

    def __init__(self, frame: DataFrame, directions: tuple[bool, ...] | None = None, skipped: int = 0):
        self._frame, self.directions, self._skipped = frame, directions, skipped

    @classmethod
    def over(cls, df: DataFrame, order_by: Any = None) -> Self:
        """A flow over a DataFrame; order_by: names, Columns or lambdas (``Desc`` for descending) that order its rows.  Rows that tie in all of them follow each other in any order."""
        if order_by is None:
            return cls(df)
        keys = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
        row = Row(df.columns)
        columns = [column(k.key if isinstance(k, Desc) else k, row).alias(f"{HIDDEN}{i}") for i, k in enumerate(keys)]
        return cls(df.select("*", *columns), tuple(not isinstance(k, Desc) for k in keys))

    @property
    def frame(self) -> DataFrame:
        """Elements and hidden order columns."""
        if self._skipped:
            at = "__skip_at"
            kept = prefix.indexed(self._frame, self._order(), at)
            return kept.where(F.col(at) >= self._skipped).drop(at)
        return self._frame

    @property
    def spark(self) -> SparkSession:
        return self._frame.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self._frame.columns if not c.startswith(HIDDEN)]

    @property
    def df(self) -> DataFrame:
        """The elements, in no promised order."""
        return self.frame.select(*self._payload())

    @property
    def sorted_df(self) -> DataFrame:
        """The elements, sorted in the order of the flow."""
        return self.frame.orderBy(*self._order()).select(*self._payload()) if self.directions else self.df

    @property
    def row(self) -> Row:
        return Row(self.columns)

    @property
    def is_ordered(self) -> bool:
        return self.directions is not None

    def transform(self, f: Any) -> Self:
        """Own operators: f takes the flow and returns one."""
        return f(self)

    def with_frame(self, f: Any) -> Self:
        """Own operators on DataFrames: f must keep the hidden order columns."""
        return type(self)(f(self.frame), self.directions)

    def ordered(self, *keys: Any) -> Self:
        """Keeps the order; with keys, orders by these instead."""
        if keys:
            return type(self).over(self.df, list(keys))
        self._needs_order("ordered without keys")
        return self

    def unordered(self) -> Self:
        return type(self)(self.df)

    def with_degree_of_parallelism(self, n: int) -> Self:
        """At most n tasks for what follows, without a shuffle up to what the cluster runs at once; beyond that n."""
        if n < 1:
            raise ValueError("the degree of parallelism must be 1 or more")
        few = n <= self.spark.sparkContext.defaultParallelism
        return self._same(self.frame.coalesce(n) if few else self.frame.repartition(n))

    def cache(self) -> Self:
        """Keeps the rows once they are computed; a run that stops early does not shorten them."""
        return type(self)(self.frame.persist(), self.directions)

    def unpersist(self) -> Self:
        self._frame.unpersist()
        return self

    def _names(self) -> list[str]:
        return [f"{HIDDEN}{i}" for i in range(len(self.directions or ()))]

    def _payload(self) -> list[Column]:
        return [self.row[c] for c in self.columns]

    def _order(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in zip(self._names(), self.directions or (), strict=True)]

    def _needs_order(self, what: str) -> None:
        if self.directions is None:
            raise NoOrder(f"{what} needs an order: call ordered(keys) or sort_by first")

    def _same(self, frame: DataFrame) -> Self:
        return type(self)(frame, self.directions)

    def _select(self, columns: Iterable[Column]) -> Self:
        return self._same(self.frame.select(*self._names(), *columns))

    def _indexed(self, name: str, small: int | None = None) -> DataFrame:
        return prefix.indexed(self.frame, self._order(), name, prefix.SMALL if small is None else small)
