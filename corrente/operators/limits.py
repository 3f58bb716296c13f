"""take, skip, take_while and sorts.  A sort only sets the order of the flow; Spark sorts where an operator needs it, and take after it is a top-k."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import HIDDEN, Expression, column, truth
from ..plans.durable import materialised
from .base import Base, Desc

#: Distinct keys that one array holds for a sort by a comparison, on average; bounds that cut a bucket into smaller ones at once; levels of bounds whose table is broadcast.
KEYS_A_BUCKET, BOUNDS, BROADCAST_LEVELS = 4096, 512, 2
_PLACE_BITS = 15


class Limits(Base):
    def take(self, n: int) -> Self:
        """The first n elements (any n without an order)."""
        if n < 0:
            raise ValueError("take needs a count of 0 or more")
        if not self.directions:
            return self._same(self.frame.limit(n))
        # one top-k of skipped and taken elements together
        first = self._frame.orderBy(*self._order()).limit(self._skipped + n)
        return self._same(first.offset(self._skipped) if self._skipped else first)

    def skip(self, n: int) -> Self:
        """Without the first n elements (any n without an order); a negative n skips none."""
        return type(self)(self._frame, self.directions, self._skipped + max(n, 0))

    def take_while(self, p: Expression) -> Self:
        """The elements before the first for which p is not true."""
        self._needs_order("take_while")
        names = self._names()
        stop = self.frame.where(~truth(p, self.row)).orderBy(*self._order()).limit(1).select(*[F.col(c).alias(f"__stop{i}") for i, c in enumerate(names)], F.lit(True).alias("__stops"))
        both = self.frame.join(F.broadcast(stop), F.lit(True), "left")  # one row at most
        earlier, same = F.lit(False), F.lit(True)
        for i, (c, up) in enumerate(zip(names, self.directions or (), strict=True)):
            own, end = F.col(c), F.col(f"__stop{i}")
            less = (own.isNull() & end.isNotNull()) | F.coalesce(own < end, F.lit(False)) if up else (own.isNotNull() & end.isNull()) | F.coalesce(own > end, F.lit(False))
            earlier, same = earlier | (same & less), same & own.eqNullSafe(end)
        return self._same(both.where(F.col("__stops").isNull() | earlier).select(*self._frame.columns))

    def _ordered_by(self, keys: list[tuple[Column, bool]], frame: DataFrame | None = None) -> Self:
        frame = self.frame if frame is None else frame
        n = len(keys)
        kept = [F.col(c).alias(f"{HIDDEN}{n + i}") for i, c in enumerate(self._names())]
        return type(self)(frame.select(*[k.alias(f"{HIDDEN}{i}") for i, (k, _) in enumerate(keys)], *kept, *self._payload()), (*[up for _, up in keys], *(self.directions or ())))

    def sort_by(self, key: Expression) -> Self:
        """Ascending; NULL first, NaN last; elements that tie keep their order."""
        return self._ordered_by([(column(key, self.row), True)])

    def sort_by_descending(self, key: Expression) -> Self:
        return self._ordered_by([(column(key, self.row), False)])

    def sort_by_using(self, key: Expression, comparer: Callable[[Column, Column], Column] | None = None, *, keys: Callable[[Column], list[Any]] | None = None) -> Self:
        """By a comparison of keys: comparer(a, b) is below 0, 0 or above 0.

        ``keys`` states the same order by sort keys of the key, which is a plain sort.  A comparer is applied to distinct keys only, null being the first of them: samples of them bound buckets, which are cut again until they are small, then sorted one by one, and every element gets the rank of its key.  So a key that a third of all elements have costs one comparison."""
        k = column(key, self.row)
        if keys is not None:
            return self._ordered_by([(column(x.key, self.row), False) if isinstance(x, Desc) else (column(x, self.row), True) for x in keys(k)])
        if comparer is None:
            raise ValueError("sort_by_using needs a comparer or keys")
        keyed = self.frame.withColumn("__key", k)
        distinct = materialised(keyed.select("__key").distinct())
        runs = _bucketed(distinct, comparer).groupBy("__bucket").agg(_sorted_keys(comparer).alias("__run"))
        ranked = runs.select("__bucket", F.posexplode("__run").alias("__at", "__item")).select("__bucket", "__at", "__item.__key")
        # keys that compare as equal share the rank of the first of them
        lead = F.expr("lag(__key) over (partition by __bucket order by __at)")
        ranked = ranked.withColumn("__new", F.when(F.col("__at") == 0, 1).otherwise((_nulls_first(comparer, lead, F.col("__key")) != 0).cast("int")))
        ranked = ranked.withColumn("__rank", F.expr("sum(__new) over (partition by __bucket order by __at)"))
        both = keyed.join(materialised(ranked.select("__key", "__bucket", "__rank")).withColumnRenamed("__key", "__key2"), F.col("__key").eqNullSafe(F.col("__key2")))
        return self._ordered_by([(F.col("__bucket"), True), (F.col("__rank"), True)], both)

    def top(self, n: int, key: Expression) -> Self:
        """sort_by_descending and take: each task keeps its n best."""
        return self.sort_by_descending(key).take(n)


def _nulls_first(comparer: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Comparers see no nulls."""
    return F.when(a.isNull() | b.isNull(), b.isNull().cast("int") - a.isNull().cast("int")).otherwise(comparer(a, b))


def _sorted_keys(comparer: Callable[[Column, Column], Column]) -> Column:
    """The keys in structs, as arrays are collected without their nulls."""
    return F.array_sort(F.collect_list(F.struct("__key")), lambda a, b: _nulls_first(comparer, a["__key"], b["__key"]))


def _bucketed(distinct: DataFrame, comparer: Callable[[Column, Column], Column]) -> DataFrame:
    """The keys with their bucket; buckets ascend in the order, and keys that compare as equal share one.  Every level cuts all buckets by samples of their own keys, chosen by a hash, so the number of buckets follows that of the keys."""
    out, count, buckets, level = distinct.withColumn("__bucket", F.lit(0).cast("long")), distinct.count(), 1, 0
    while count > buckets * KEYS_A_BUCKET:
        cuts = min(BOUNDS, -(-count // (buckets * KEYS_A_BUCKET)))
        chosen = F.xxhash64(F.lit(level), "__key") < int(min(1.0, buckets * cuts / count) * 2**64) - 2**63
        bounds = out.where(chosen).groupBy("__bucket").agg(_sorted_keys(comparer).alias("__bounds"))
        # BOUNDS keys a bucket: few enough at first, while later a bucket is too small a key to be a hot one
        both = out.join(F.broadcast(bounds) if level < BROADCAST_LEVELS else bounds, "__bucket", "left")
        below = F.filter("__bounds", lambda b: _nulls_first(comparer, b["__key"], F.col("__key")) <= 0)
        place = F.when(F.col("__bounds").isNull(), 0).otherwise(F.size(below))
        out = materialised(both.select("__key", (F.shiftleft("__bucket", _PLACE_BITS) + place).alias("__bucket")))
        buckets, level = buckets * cuts, level + 1
    return out
