"""Endless sequences.  They cannot be run, only cut: take and the searches run them over ranges that grow until they have what they need."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..flow import Flow
from ..functions.rows import HIDDEN, Expression, Row, named
from ..operators.base import NotFound
from ..operators.custom import arrow_batch, arrow_schema

_FIRST, _GROWTH, _MOST = 1024, 8, 1 << 40
Step = Callable[[Flow], Flow]


class Unbounded(ValueError):
    """The operator would need all elements of an endless flow."""


class Endless:
    """source: the flow of the first n elements; steps: what is to be done with it; exact: whether each step keeps the number of elements."""

    def __init__(self, spark: SparkSession, source: Callable[[int], Flow], steps: tuple[Step, ...] = (), exact: bool = True):
        self.spark, self.source, self.steps, self.exact = spark, source, steps, exact

    def _then(self, step: Step, exact: bool) -> Endless:
        return Endless(self.spark, self.source, (*self.steps, step), self.exact and exact)

    def map(self, f: Expression) -> Endless:
        return self._then(lambda x: x.map(f), True)

    def mapi(self, f: Expression) -> Endless:
        return self._then(lambda x: x.mapi(f), True)

    def filter(self, p: Expression) -> Endless:
        return self._then(lambda x: x.filter(p), False)

    def choose(self, f: Expression) -> Endless:
        return self._then(lambda x: x.choose(f), False)

    def flat_map(self, f: Expression) -> Endless:
        return self._then(lambda x: x.flat_map(f), False)

    def map_py(self, f: Callable[..., Any], schema: str) -> Endless:
        return self._then(lambda x: x.map_py(f, schema), True)

    def scan(self, kind: str, f: Expression, seed: Any, **options: Any) -> Endless:
        """As of a flow; the seed is one more element."""
        return self._then(lambda x: x.scan(kind, f, seed, **options), False)

    def skip(self, n: int) -> Endless:
        return self._then(lambda x: x.skip(n), n <= 0)

    def beginning(self, n: int) -> Flow:
        """What becomes of the first n elements of the source."""
        flow = self.source(n)
        for step in self.steps:
            flow = step(flow)
        return flow

    def take(self, n: int) -> Flow:
        if n < 0:
            raise ValueError("take needs a count of 0 or more")
        if self.exact or n == 0:
            return self.beginning(n)
        return self._grown(lambda x: x.take(n), lambda x: x.length() >= n)

    def _grown(self, cut: Callable[[Flow], Flow], enough: Callable[[Flow], bool]) -> Flow:
        n = _FIRST
        while True:
            out = cut(self.beginning(n))
            if enough(out):
                return out
            if n >= _MOST:
                raise NotFound(f"not enough elements fit among the first {_MOST}")
            n *= _GROWTH

    def take_while(self, p: Expression) -> Flow:
        """Ends with the first element for which p is not true; never, if there is none."""
        n = _FIRST
        while not self.beginning(n).exists(lambda r: ~F.coalesce(p(r), F.lit(False))):
            n *= _GROWTH
            if n > _MOST:
                raise NotFound("take_while does not end")
        return self.beginning(n).take_while(p)

    def find(self, p: Expression) -> Any:
        return self.filter(p).head()

    try_find = find

    def pick(self, f: Expression) -> Any:
        return self.choose(f).head()

    try_pick = pick

    def head(self) -> Any:
        return self.take(1).head()

    def exists(self, p: Expression) -> bool:
        """True as soon as an element fits."""
        return self.find(p) is not None

    def zip_with(self, other: Flow | Endless, f: Expression) -> Flow | Endless:
        """With a finite flow, which decides the length, or with another endless one."""
        if isinstance(other, Endless):
            return Endless(self.spark, lambda n: self.beginning(n).zip_with(other.beginning(n), f), (), self.exact and other.exact)
        n = other.length()
        return self.take(n).zip_with(other, f)

    def __getattr__(self, name: str) -> Any:
        if hasattr(Flow, name):
            raise Unbounded(f"{name} needs a finite flow: take(n) first")
        raise AttributeError(name)


def _of_index(spark: SparkSession, f: Callable[[Column], list[Column]]) -> Endless:
    return Endless(spark, lambda n: Flow(spark.range(n).select(F.col("id").alias(f"{HIDDEN}0"), *f(F.col("id"))), (True,)))


def init_infinite(spark: SparkSession, f: Expression) -> Endless:
    """f(0), f(1), ...: f gets the index as a Column."""
    return _of_index(spark, lambda i: named(lambda _: f(i), Row([])))


def generate_infinite(spark: SparkSession, f: Callable[[], Any]) -> Endless:
    """f() again and again, an expression without an argument (such as rand() or a constant)."""
    return _of_index(spark, lambda _: named(lambda _: f(), Row([])))


def generate_infinite_py(spark: SparkSession, make: Callable[[], Callable[[], Any]], schema: str) -> Endless:
    """As generate_infinite, of a Python function that may keep a state.

    make() gives the function anew for every run, so that all runs start from the same state.  A state goes from call to call, so one task makes all calls, a batch of rows at a time; schema names the columns of what f gives, a tuple if there are several."""
    full = f"{HIDDEN}0 long, {schema}"
    kind = arrow_schema(full)

    def of(n: int) -> Flow:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = make()
            for batch in batches:
                made = [(i, f()) for i in batch.column(0).to_pylist()]
                if made:
                    yield arrow_batch([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in made], kind)

        return Flow(spark.range(0, n, 1, 1).mapInArrow(work, full), (True,))

    return Endless(spark, of)
