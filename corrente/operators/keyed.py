"""fold_by, group_by, count_by.  Results keep the order in which keys were first seen, if the flow has an order."""

from __future__ import annotations

from typing import Any, Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import HIDDEN, Expression, column
from .aggregate import Aggregate, _Element


class Keyed(Aggregate):
    def _keyed(self, key: Expression, aggregates: list[Column], source: Keyed | None = None) -> Self:
        """groupBy with aggregates; a null key is a key of its own."""
        k = column(key, self.row).alias("key")
        if self.directions is None:
            return type(self)(self.frame.groupBy(k).agg(*aggregates))
        if all(self.directions):
            first = F.min(F.struct(*self._names())).alias("__first")
            out = self.frame.groupBy(k).agg(first, *aggregates)
            names = [F.col(f"__first.{c}").alias(c) for c in self._names()]
            return type(self)(out.select(*names, *[c for c in out.columns if c != "__first"]), self.directions)
        at = f"{HIDDEN}_at"
        out = self._indexed(at).groupBy(k).agg(F.min(at).alias(f"{HIDDEN}0"), *aggregates)
        return type(self)(out, (True,))

    def fold_by(self, key: Expression, **folds: Expression | Column) -> Self:
        """Columns key and one for each fold (an aggregate function of Columns): partial aggregation in each task, one shuffle of keys and states."""
        return self._keyed(key, [column(f, self.row).alias(name) for name, f in folds.items()])

    def fold_by_ordered(self, key: Expression, folder: Expression, seed: Any) -> Self:
        """Columns key and value: folder(state, element) over the elements of each key in their order.  The elements of a key meet in one array; ``fold_by_py`` reads them one by one."""
        self._needs_order("fold_by_ordered")
        folded = F.aggregate(self._collected(F.lit(True)), column(seed), lambda s, x: column(folder, s, _Element(self.columns, x)))
        return self._keyed(key, [folded.alias("value")])

    def group_by(self, key: Expression) -> Self:
        """Columns key and items, the array of the key's elements in their order."""
        return self._keyed(key, [self._collected(F.lit(True)).alias("items")])

    def count_by(self, key: Expression) -> Self:
        """Columns key and count."""
        return self._keyed(key, [F.count("*").alias("count")])

    def distinct_keys(self, key: Expression) -> DataFrame:
        return self.frame.select(column(key, self.row).alias("key")).distinct()
