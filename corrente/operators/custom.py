"""Python functions, where Columns cannot state a step: Arrow batches, never row by row through the JVM, and no more memory than a batch and the state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Self

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.rows import HIDDEN, Expression, column
from .base import Base


class Collector:
    """A custom parallel aggregate: one state for each task, merged at the end.  init() must be neutral under merge."""

    def init(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, batch: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, state: Any) -> Any:
        return state


class Custom(Base):
    def map_py(self, f: Callable[[pd.DataFrame], pd.DataFrame | pd.Series], schema: str) -> Self:
        """f maps a batch of elements to as many; schema names its columns.  Order is kept."""
        names, hidden = self.columns, self._names()
        out = [c.split()[0] for c in schema.split(",")]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = f(batch[names])
                x = x.to_frame(out[0]) if isinstance(x, pd.Series) else x[out]
                yield pd.concat([batch[hidden].reset_index(drop=True), x.reset_index(drop=True)], axis=1)

        return self._same(self.frame.mapInPandas(work, self._hidden_schema(schema)))

    def filter_py(self, p: Callable[[pd.DataFrame], pd.Series]) -> Self:
        names = self.columns

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[p(batch[names]).fillna(False).astype(bool).to_numpy()]

        return self._same(self.frame.mapInPandas(work, self._frame.schema))

    def map_udf(self, f: Any, *columns: str, name: str = "value") -> Self:
        """A pandas_udf (or any Spark function) of some columns."""
        return self._select([f(*[self.row[c] for c in columns]).alias(name)])

    def flat_map_py(self, f: Callable[..., Iterable[Any]], schema: str, *columns: str) -> Self:
        """0 to n elements for each, in order: f gets the values of ``columns`` (all, if none are named) and gives the elements, as tuples if there are several columns."""
        take, hidden = list(columns) or self.columns, self._names()
        inner = [f"{HIDDEN}{len(hidden)}"] if self.directions is not None else []
        full = self._hidden_schema(", ".join([*(f"{c} long" for c in inner), schema]))
        kind = arrow_schema(full)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                orders, values = _tuples(batch, hidden), _tuples(batch, take)
                for order, value in zip(orders, values, strict=True):
                    for i, x in enumerate(f(*value)):
                        rows.append((*order, *([i] if inner else []), *(x if isinstance(x, tuple) else (x,))))
                        if len(rows) >= _ROWS:
                            yield arrow_batch(rows, kind)
                            rows = []
                if rows:
                    yield arrow_batch(rows, kind)

        return type(self)(self.frame.mapInArrow(work, full), (*self.directions, True) if self.directions is not None else None)

    def fold_parallel_py(self, collector: Collector, schema: str = "value double") -> DataFrame:
        """The collector's result as one row: a state for each task, merged in pairs of growing groups, so no task merges more than a few hundred."""
        return _merged(self.df, collector, schema)

    def apply(self, collector: Collector) -> Any:
        """The collector's result as a value."""
        found = _states(self.df, collector).first()
        return collector.result(collector.init()) if found is None else pickle_loads(found[0])

    def fold_py(self, folder: Callable[[Any, Any], Any], seed: Any) -> Any:
        """folder(state, element) in the order; one task reads sorted batches and keeps only the state.  An element of one column is its value, else a tuple."""
        names = self.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = seed
            for batch in batches:
                for x in _elements(batch, names):
                    state = folder(state, x)
            yield pa.RecordBatch.from_arrays([pa.array([pickle_dumps(state)], pa.binary())], names=["state"])

        found = self._one_sorted_task().mapInArrow(work, "state binary").first()
        return seed if found is None else pickle_loads(found[0])  # no task runs for a relation that is known to be empty

    def scan_py(self, folder: Callable[[Any, Any], Any], seed: Any, kind: str) -> Self:
        """All states of fold_py, the seed first, as the column ``value``."""
        names, full = self.columns, f"{HIDDEN}0 long, value {kind}"
        schema = arrow_schema(full)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, at = seed, 0
            for batch in batches:
                rows = []
                for x in _elements(batch, names):
                    state, at = folder(state, x), at + 1
                    rows.append((at, state))
                if rows:
                    yield arrow_batch(rows, schema)

        first = self.spark.createDataFrame([(0, seed)], full)
        return type(self)(first.unionByName(self._one_sorted_task().mapInArrow(work, full)), (True,))

    def fold_by_py(self, key: Expression, folder: Callable[[Any, Any], Any], init: Callable[[], Any], kind: str) -> Self:
        """Columns key and value: folder(state, element) over each key's elements in their order.  Keys are dealt out and sorted with the order behind them, so a task reads a key one element after another, however many elements it has."""
        names, k = self.columns, column(key, self.row)
        rows = self.frame.withColumn("__key", k)
        rows = rows.repartition("__key").sortWithinPartitions(F.col("__key").asc_nulls_first(), *self._order())
        full = f"key {rows.schema['__key'].dataType.simpleString()}, value {kind}"
        schema = arrow_schema(full)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, now, state = False, None, None
            for batch in batches:
                done = []
                for k, x in zip(batch.column("__key").to_pylist(), _elements(batch, names), strict=True):
                    if not begun or not (k == now or (k != k and now != now)):  # NaN is one key
                        if begun:
                            done.append((now, state))
                        begun, now, state = True, k, init()
                    state = folder(state, x)
                if done:
                    yield arrow_batch(done, schema)
            if begun:
                yield arrow_batch([(now, state)], schema)

        return type(self)(rows.mapInArrow(work, full))

    def lateral_udtf(self, udtf: Any, *arguments: Column | Expression) -> Self:
        """The rows of a Python table function for each element, beside it; without an order among them."""
        args = [column(a, self.row) for a in arguments]
        frame = self.frame.withColumns({f"__arg{i}": a for i, a in enumerate(args)})
        out = frame.lateralJoin(udtf(*[F.col(f"__arg{i}").outer() for i in range(len(args))]))
        return self._same(out.drop(*[f"__arg{i}" for i in range(len(args))]))

    def _one_sorted_task(self) -> DataFrame:
        self._needs_order("a fold in order")
        return self.frame.repartition(1).sortWithinPartitions(*self._order())

    def _hidden_schema(self, schema: str) -> str:
        return ", ".join([*(f"{c} {self._frame.schema[c].dataType.simpleString()}" for c in self._names()), schema])


#: Rows of a batch that is built from Python values.
_ROWS = 10_000


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.DataType.fromDDL(ddl))


def arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _tuples(batch: pa.RecordBatch, names: list[str]) -> Iterable[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True) if names else [()] * batch.num_rows


def _elements(batch: pa.RecordBatch, names: list[str]) -> Iterable[Any]:
    return _tuples(batch, names) if len(names) > 1 else batch.column(names[0]).to_pylist()


def pickle_dumps(x: Any) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(x)


def pickle_loads(x: bytes) -> Any:
    import pickle

    return pickle.loads(bytes(x))


_FAN = 64


def _states(df: DataFrame, collector: Collector) -> DataFrame:
    """One row with the pickled merged state's result."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = collector.init()
        for batch in batches:
            state = collector.update(state, batch)
        yield pd.DataFrame({"state": [pickle_dumps(state)]})

    def merge(last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = collector.init()
            for batch in batches:
                for x in batch["state"]:
                    state = collector.merge(state, pickle_loads(x))
            yield pd.DataFrame({"state": [pickle_dumps(collector.result(state) if last else state)]})

        return work

    n = df.rdd.getNumPartitions()
    out = df.mapInPandas(start, "state binary")
    while n > _FAN:
        n = -(-n // _FAN)
        out = out.coalesce(n).mapInPandas(merge(False), "state binary")
    return out.repartition(1).mapInPandas(merge(True), "state binary")


def _merged(df: DataFrame, collector: Collector, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [pickle_loads(x) for x in batch["state"]]
            yield pd.DataFrame([x if isinstance(x, tuple) else (x,) for x in rows], columns=names)

    return _states(df, collector).mapInPandas(unpack, schema)
