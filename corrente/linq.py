"""The other names that the operators go by: select, where, order_by and so on."""

from __future__ import annotations

from typing import Any, Self

from pyspark.sql import Row as Record

from .functions.rows import Expression
from .operators.base import Base


class InvalidOperation(LookupError):
    """first has no element to give."""


class Linq(Base):
    def select(self, f: Expression) -> Self:
        return self.map(f)

    def select_many(self, f: Expression) -> Self:
        return self.flat_map(f)

    def where(self, p: Expression) -> Self:
        return self.filter(p)

    def aggregate(self, **folds: Expression) -> Any:
        return self.fold(**folds)

    def aggregate_by(self, key: Expression, **folds: Expression) -> Self:
        return self.fold_by(key, **folds)

    def order_by(self, key: Expression, comparer: Any = None) -> Self:
        return self.sort_by(key) if comparer is None else self.sort_by_using(key, comparer)

    def order_by_descending(self, key: Expression) -> Self:
        return self.sort_by_descending(key)

    def count(self) -> int:
        return self.length()

    def zip(self, other: Base, f: Expression) -> Self:
        return self.zip_with(other, f)

    def any(self, p: Expression) -> bool:
        return self.exists(p)

    def all(self, p: Expression) -> bool:
        return self.forall(p)

    def first(self, p: Expression | None = None) -> Record:
        found = self.try_head() if p is None else self.try_find(p)
        if found is None:
            raise InvalidOperation("first: no element")
        return found

    def first_where_or_default(self, p: Expression, default: Any = None) -> Any:
        return self.filter(p).first_or_default(default)

    def as_ordered(self, *keys: Any) -> Self:
        return self.ordered(*keys)

    def as_unordered(self) -> Self:
        return self.unordered()

    def as_flow(self, *keys: Any) -> Self:
        return self.ordered(*keys)

    def as_parallel_flow(self) -> Self:
        return self.unordered()

    def to_enumerable(self) -> Any:
        return self.to_seq()
