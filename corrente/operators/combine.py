"""Positional pairing and concatenation."""

from __future__ import annotations

from functools import reduce
from typing import Self

from pyspark.sql import functions as F

from ..functions.rows import HIDDEN, Expression, Row, named
from .base import Base


class Combine(Base):
    def zip_with(self, other: Combine, f: Expression, *, small: int | None = None) -> Self:
        """f(a, b) of the elements at equal places; the shorter flow decides the length."""
        self._needs_order("zip_with")
        other._needs_order("zip_with")
        left = self._indexed("__at", small).select("__at", *self._names(), F.struct(*self._payload()).alias("__a"))
        right = other._indexed("__at", small).select("__at", F.struct(*other._payload()).alias("__b"))
        both = left.join(right, "__at")
        return self._same(both.select(*self._names(), *named(f, Row(self.columns, "__a"), Row(other.columns, "__b"))))

    def concat(self, *others: Combine, ordinal: str | None = None) -> Self:
        """The elements of all flows one flow after another, copies kept; columns go by name.  ``ordinal`` names a column for the place of the flow."""
        flows = [self, *others]
        ordered = all(x.directions is not None for x in flows)
        kinds = {tuple((x._frame.schema[c].dataType.simpleString(), up) for c, up in zip(x._names(), x.directions or (), strict=True)) for x in flows}
        if not ordered:
            order, frames = None, [x.df for x in flows]
        elif len(kinds) == 1:
            order = (True, *(self.directions or ()))
            frames = [x.frame.select(F.lit(i).alias(f"{HIDDEN}0"), *[F.col(c).alias(f"{HIDDEN}{k + 1}") for k, c in enumerate(x._names())], *x._payload()) for i, x in enumerate(flows)]
        else:  # orders of several kinds: by place within each flow
            order = (True, True)
            frames = [x._indexed("__at").select(F.lit(i).alias(f"{HIDDEN}0"), F.col("__at").alias(f"{HIDDEN}1"), *x._payload()) for i, x in enumerate(flows)]
        if ordinal:
            frames = [x.withColumn(ordinal, F.lit(i)) for i, x in enumerate(frames)]
        return type(self)(reduce(lambda a, b: a.unionByName(b), frames), order)
