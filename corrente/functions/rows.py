"""Lambdas over a row become Column expressions, so that pushdown, pruning and code generation keep working."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of this prefix carry the order of a flow and are not part of its elements.
HIDDEN = "__ord"


class Row:
    """The element that a lambda gets: ``r.x`` and ``r["x"]`` are the column x."""

    def __init__(self, columns: list[str], inside: str | None = None):
        self.__dict__.update(_columns=tuple(columns), _inside=inside)

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise KeyError(f"no column {name!r} among {list(self._columns)}")
        return F.col((f"`{self._inside}`." if self._inside else "") + "`" + name.replace("`", "``") + "`")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def __iter__(self) -> Iterator[Column]:
        return (self[c] for c in self._columns)


Expression = Callable[..., "Column | Mapping[str, Column] | object"]


def column(f: Expression | Column | str, *rows: Row) -> Column:
    """The Column of a lambda, a Column or a column's name; other values are literals."""
    out = f(*rows) if callable(f) and not isinstance(f, Column) else F.col(f) if isinstance(f, str) else f
    return out if isinstance(out, Column) else F.lit(out)


def named(f: Expression | Column | str | Mapping[str, object], *rows: Row) -> list[Column]:
    """The columns of a result: those of a mapping by their names, a lone Column as ``value``."""
    out = f(*rows) if callable(f) and not isinstance(f, Column) else f
    if isinstance(out, Mapping):
        return [column(v, *rows).alias(k) for k, v in out.items()]
    return [column(out, *rows).alias("value")]


def truth(f: Expression | Column | str, *rows: Row) -> Column:
    """A predicate without a third value: null is false."""
    return F.coalesce(column(f, *rows), F.lit(False))
