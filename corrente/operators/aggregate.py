"""Folds over a whole flow.  ``*_df`` twins give a DataFrame of one row instead of a value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Row as Record
from pyspark.sql import functions as F

from ..functions.rows import Expression, Row, column
from .base import Base, EmptyFlow


class Aggregate(Base):
    def fold_df(self, **folds: Expression | Column) -> DataFrame:
        """Folds that Spark's aggregate functions state, e.g. ``total=lambda r: F.sum(r.x)``: partial in each task, then combined."""
        return self.df.agg(*[column(f, self.row).alias(name) for name, f in folds.items()])

    def fold(self, **folds: Expression | Column) -> Any:
        out = self.fold_df(**folds).first()
        return out[0] if len(folds) == 1 else out

    def fold_ordered_df(self, folder: Expression, seed: Any, *, finish: Expression | None = None) -> DataFrame:
        """folder(state, element) from the first element to the last, for folders of Columns that depend on the order.  The elements meet in one array; ``fold_py`` needs no more memory than its state."""
        self._needs_order("fold_ordered")
        state = column(seed)
        items = self._collected(F.lit(True))
        folded = F.aggregate(items, state, lambda s, x: column(folder, s, _Element(self.columns, x)), *([lambda s: column(finish, s)] if finish else []))
        return self._for_arrays().agg(folded.alias("value"))

    def fold_ordered(self, folder: Expression, seed: Any, **options: Any) -> Any:
        return self.fold_ordered_df(folder, seed, **options).first()[0]

    def sum_df(self, f: Expression | str | None = None) -> DataFrame:
        """0 for an empty flow; an overflow is an error.  Without f the flow must have one column."""
        if f is None and len(self.columns) != 1:
            raise ValueError(f"sum needs to know which of the columns {self.columns} to add up")
        x = column(f or self.columns[0], self.row)
        return self.df.agg(F.coalesce(F.sum(x), F.lit(0)).alias("value"))

    def sum(self, f: Expression | str | None = None) -> Any:
        return self.sum_df(f).first()[0]

    def length_df(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("value"))

    def length(self) -> int:
        return self.frame.count()

    def _extreme(self, key: Expression, largest: bool) -> DataFrame:
        k = column(key, self.row)
        found = self.frame.withColumn("__key", k).where(F.col("__key").isNotNull())
        first = F.col("__key").desc() if largest else F.col("__key").asc()
        return found.orderBy(first, *self._order()).limit(1).select(*self._payload())

    def max_by_df(self, key: Expression) -> DataFrame:
        """The first element of the largest key (any, without an order); null keys take no part.  One row, or none."""
        return self._extreme(key, True)

    def min_by_df(self, key: Expression) -> DataFrame:
        """The first element of the smallest key."""
        return self._extreme(key, False)

    def max_by(self, key: Expression) -> Record:
        return _only(self.max_by_df(key), "max_by")

    def min_by(self, key: Expression) -> Record:
        return _only(self.min_by_df(key), "min_by")

    # arrays of elements that carry their order

    def _for_arrays(self) -> DataFrame:
        return self.frame

    def _collected(self, keep: Column) -> Column:
        """Aggregate: the elements for which ``keep`` is true as an array of structs, in the order of the flow."""
        entry = F.struct(F.struct(*self._names()).alias("o") if self._names() else F.lit(0).alias("o"), F.struct(*self._payload()).alias("e"))
        items = F.collect_list(F.when(keep, entry))
        if self.directions:
            items = F.array_sort(items) if all(self.directions) else F.array_sort(items, _comparer(self._names(), self.directions))
        return F.transform(items, lambda x: x["e"])


class _Element(Row):
    """An element inside an array."""

    def __init__(self, columns: list[str], struct: Column):
        super().__init__(columns)
        self.__dict__["_struct"] = struct

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise KeyError(f"no column {name!r} among {list(self._columns)}")
        return self._struct.getField(name)


def _comparer(names: list[str], directions: tuple[bool, ...]) -> Any:
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, up in reversed(list(zip(names, directions, strict=True))):
            x, y = a["o"][name], b["o"][name]
            if not up:
                x, y = y, x
            less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
            more = (y.isNull() & x.isNotNull()) | F.coalesce(x > y, F.lit(False))
            out = F.when(less, -1).when(more, 1).otherwise(out)
        return out

    return compare


def _only(df: DataFrame, what: str) -> Record:
    rows = df.take(1)
    if not rows:
        raise EmptyFlow(f"{what} of an empty flow")
    return rows[0]
