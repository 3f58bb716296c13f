"""Row numbers and running aggregates over a total order, without one task that sees all rows.

A window without PARTITION BY pulls everything into one task.  Beyond ``SMALL``
estimated bytes or ``ROWS`` rows the rows are dealt by ranges of the order and sorted
within the ranges instead; every range is summed up on its own, the sums of all ranges
before (as many rows as ranges, so broadcast) are added to each.  Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import estimated_bytes, materialised

#: Estimated bytes and rows up to which one task does a window over all rows, and which a range should have.
SMALL, ROWS = 16 << 20, 1 << 19
#: For the sake of bytes alone there are no ranges of fewer rows, nor more ranges.
LEAST_ROWS, MOST_RANGES = 4096, 2048
#: Estimated bytes a row beyond which the estimate says nothing: that of a join is a product, that of stored rows a constant.  LEAST_ROWS then counts so many times.
_UNKNOWN, _UNKNOWN_X = 1 << 20, 16
_ROW_BITS = 33  # of monotonically_increasing_id
_ID, _PART = "__row_id", "__row_part"
_COMBINE = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "count": (F.count, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def _ranges(df: DataFrame, small: int) -> int:
    """How many ranges the rows are dealt to, so that a range stays as large as it is while the input grows; 0: one window will do.  Rows are counted, as the estimate knows neither how far a file is compressed nor how many rows an array becomes."""
    size, rows = estimated_bytes(df), df.count()
    if size <= small and rows <= ROWS:
        return 0
    least = LEAST_ROWS * (_UNKNOWN_X if size > rows * _UNKNOWN else 1)
    return max(-(-rows // ROWS), min(size // SMALL, rows // least, MOST_RANGES), 1)


def _in_ranges(df: DataFrame, order: list[Column], ranges: int = 0) -> DataFrame:
    """The rows with an id that ascends in the order, and the range that each is in.  Written down, as ids must not change between the two passes."""
    if order:
        # with a number of its own, as ranges that are merged while the query runs go by compressed bytes
        df = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return materialised(df.withColumn(_ID, F.monotonically_increasing_id())).withColumn(_PART, F.shiftrightunsigned(_ID, _ROW_BITS))


def _before(parts: DataFrame, sums: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each range the aggregates of all ranges before it; one row a range."""
    totals = parts.groupBy(_PART).agg(*[_COMBINE[kind][0](value).alias(f"__total_{name}") for name, (kind, value) in sums.items()])
    window = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    gather = {"count": F.sum}
    return totals.select(_PART, *[gather.get(kind, _COMBINE[kind][0])(f"__total_{name}").over(window).alias(f"__before_{name}") for name, (kind, _) in sums.items()])


def indexed(df: DataFrame, order: list[Column], name: str, small: int = SMALL) -> DataFrame:
    """Adds the 0-based number of every row in the order; without an order, in any."""
    ranges = _ranges(df, small) if order else 0
    if order and not ranges:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    parts = _in_ranges(df, order, ranges)
    before = _before(parts, {"n": ("count", F.lit(1))})
    place = F.coalesce("__before_n", F.lit(0)) + F.col(_ID).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return parts.join(F.broadcast(before), _PART).select(*df.columns, place.cast("long").alias(name))


def running(df: DataFrame, order: list[Column], sums: dict[str, tuple[str, Column]], *, exclusive: bool = False, small: int = SMALL) -> DataFrame:
    """Adds running aggregates {name: (sum, count, min or max; of what)} over all rows up to each (``exclusive``: before it)."""
    last = -1 if exclusive else 0
    ranges = _ranges(df, small)
    if not ranges:
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *[_COMBINE[kind][0](value).over(window).alias(name) for name, (kind, value) in sums.items()])
    parts = _in_ranges(df, order, ranges)
    window = Window.partitionBy(_PART).orderBy(_ID).rowsBetween(Window.unboundedPreceding, last)
    # a window holds what its task gets: by a hash of the range that would be several ranges, or as many as compressed bytes allow
    dealt = parts.repartitionByRange(2 * ranges, _PART)  # twice, so that every range has a bound of its own
    own = dealt.select("*", *[_COMBINE[kind][0](value).over(window).alias(f"__own_{name}") for name, (kind, value) in sums.items()])
    both = own.join(F.broadcast(_before(parts, sums)), _PART)
    return both.select(*df.columns, *[_COMBINE[kind][1](F.col(f"__before_{name}"), F.col(f"__own_{name}")).alias(name) for name, (kind, _) in sums.items()])
