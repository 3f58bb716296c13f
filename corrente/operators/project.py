"""map, filter, choose, flat_map."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Self

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import HIDDEN, Expression, Row, column, named
from .base import Base


class Project(Base):
    def map(self, f: Expression | Mapping[str, object]) -> Self:
        """One element for each; f gives a Column (named ``value``) or a mapping of them."""
        return self._select(named(f, self.row))

    def mapi(self, f: Expression, *, small: int | None = None) -> Self:
        """As map; f also gets the element's number in the order, from 0, as its first argument."""
        self._needs_order("mapi")
        at = "__index"
        out = self._indexed(at, small)
        return self._same(out.select(*self._names(), *named(lambda r: f(F.col(at), r), self.row)))

    def with_column(self, **columns: Expression | Column) -> Self:
        return self._same(self.frame.withColumns({k: column(v, self.row) for k, v in columns.items()}))

    def cast(self, **types: str) -> Self:
        """Casts columns; a value that the type cannot hold is an error."""
        return self._same(self.frame.withColumns({c: self.row[c].cast(t) for c, t in types.items()}))

    def filter(self, p: Expression | Column) -> Self:
        """Elements for which p is true; a null predicate is not."""
        return self._same(self.frame.where(column(p, self.row)))

    def choose(self, f: Expression, where: Expression | None = None) -> Self:
        """map and filter at once: elements go if what f gives (of a mapping: its first column) is null.  ``where`` decides instead, if null is a value to keep."""
        if where is not None:
            return self.filter(where).map(f)
        out = self._select(named(f, self.row))
        return out.filter(out.row[out.columns[0]].isNotNull())

    def flat_map(self, f: Expression) -> Self:
        """The entries of the array that f gives, in order; an empty or null array has none.  Structs become columns, others the column ``value``."""
        items = column(f, self.row)
        if self.directions is None:
            out = type(self)(self.frame.select(F.explode(items).alias("value")))
        else:
            at = f"{HIDDEN}{len(self.directions)}"
            out = type(self)(self.frame.select(*self._names(), F.posexplode(items).alias(at, "value")), (*self.directions, True))
        kind = out._frame.schema["value"].dataType
        return out._select([F.col(f"value.`{n}`").alias(n) for n in kind.names]) if isinstance(kind, T.StructType) else out

    collect = flat_map

    def flat_map_flow(self, other: Project, f: Expression, on: Expression | None = None) -> Self:
        """Nested iteration: f(a, b) for every element a and, inside, every element b of another flow for which on(a, b) is true.

        With an equality in ``on`` it is a join that Catalyst plans by size; without ``on`` it is the full product."""
        a, b = Row(self.columns, "__a"), Row(other.columns, "__b")
        left = self.frame.select(*self._names(), F.struct(*self._payload()).alias("__a"))
        n = len(self.directions or ())
        shifted = [F.col(c).alias(f"{HIDDEN}{n + i}") for i, c in enumerate(other._names())]
        right = other.frame.select(*shifted, F.struct(*other._payload()).alias("__b"))
        both = left.crossJoin(right) if on is None else left.join(right, column(on, a, b))
        order = (*self.directions, *other.directions) if self.directions is not None and other.directions is not None else None
        hidden = [f"{HIDDEN}{i}" for i in range(len(order or ()))]
        return type(self)(both.select(*hidden, *named(f, a, b)), order)

    def exists_in(self, other: Project, on: Expression, negate: bool = False) -> Self:
        """filter by a search in another flow: elements a with (``negate``: without) some b for which on(a, b) is true."""
        a, b = Row(self.columns), Row(other.columns, "__b")
        right = other.frame.select(F.struct(*other._payload()).alias("__b"))
        # a null condition finds nothing in either join; a coalesce around it would hide its equalities, and the join would compare every pair
        return self._same(self.frame.join(right, column(on, a, b), "left_anti" if negate else "left_semi"))
