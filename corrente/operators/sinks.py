"""Where flows end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row as Record

from .base import Base


class _Again:
    """Runs the flow anew at each iteration, partition by partition."""

    def __init__(self, flow: Base):
        self.flow = flow

    def __iter__(self) -> Iterator[Record]:
        return self.flow.sorted_df.toLocalIterator(prefetchPartitions=True)


class Sinks(Base):
    def iter(self, f: Callable[[Record], Any]) -> None:
        """Calls f on the driver, element after element in the order, holding one partition at a time; without an order, on the executors in parallel."""
        if self.directions is None:
            self.df.foreach(f)
        else:
            for r in _Again(self):
                f(r)

    def iter_partitions(self, f: Callable[[Iterator[Record]], None]) -> None:
        """Calls f on the executors, once a partition."""
        self.df.foreachPartition(f)

    def to_array(self) -> list[Record]:
        return self.sorted_df.collect()

    to_list = to_resize_array = to_array

    def values(self) -> list[Any]:
        """The elements of a flow of one column."""
        return [r[0] for r in self.to_array()]

    def to_seq(self) -> _Again:
        """A lazy iterable that can be iterated again."""
        return _Again(self)

    def show(self, n: int = 20) -> None:
        self.take(n).sorted_df.show(n, truncate=False)

    def __repr__(self) -> str:
        order = "unordered" if self.directions is None else f"ordered by {len(self.directions)} keys"
        return f"{type(self).__name__}({', '.join(self.columns)}; {order})"

    def write_parquet(self, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
        """Files in the order of the flow, if it has one; ``partition_by`` deals rows into folders."""
        writer = self.sorted_df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def write_text_lines(self, path: str, mode: str = "errorifexists") -> None:
        """The first column as lines."""
        self.sorted_df.selectExpr(f"cast(`{self.columns[0]}` as string) as value").write.mode(mode).text(path)
