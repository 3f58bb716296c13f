"""scan and group_until: running state along the order, in two passes beyond what one task should hold (``corrente.plans.prefix``)."""

from __future__ import annotations

from typing import Any, Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import HIDDEN, Expression, column, truth
from ..plans import prefix
from .aggregate import Aggregate, _Element

_ADD = {"sum": lambda s, x: s + F.coalesce(x, F.lit(0)), "count": lambda s, x: s + x, "min": F.least, "max": F.greatest}


class Positional(Aggregate):
    def scan(self, kind: str, f: Expression | Column, seed: Any, *, keep: Expression | None = None, small: int | None = None) -> Self:
        """Running sum, count, min or max of f, starting from ``seed``, which is the first element: n + 1 of n.  Elements have the column ``value`` and those of ``keep`` (null beside the seed)."""
        self._needs_order("scan")
        x, state = column(f, self.row), column(seed)
        kept = [c for c in self._select_kept(keep)]
        out = prefix.running(self.frame, self._order(), {"__run": (kind, x)}, small=prefix.SMALL if small is None else small)
        value = F.col("__run") if seed is None else _ADD[kind](state, F.col("__run"))
        body = out.select(F.lit(1).alias(f"{HIDDEN}0"), *[F.col(c).alias(f"{HIDDEN}{i + 1}") for i, c in enumerate(self._names())], value.alias("value"), *kept)
        kinds = {s.name: s.dataType for s in body.schema}
        # the seed row has its own constant columns, so it never depends on the input having rows
        first = self.spark.range(1).select(*[(F.lit(0) if c == f"{HIDDEN}0" else state if c == "value" else F.lit(None)).cast(kinds[c]).alias(c) for c in body.columns])
        return type(self)(first.unionByName(body), (True, *(self.directions or ())))

    def _select_kept(self, keep: Expression | None) -> list[Column]:
        return [] if keep is None else [column(v, self.row).alias(k) for k, v in keep(self.row).items()]

    def scan_fold(self, folder: Expression, seed: Any) -> Self:
        """As scan, for any folder(state, element) of Columns; all elements meet in one array.  They are folded in blocks of about the square root of their number, then every block is scanned by itself from the state before it.  ``scan_py`` keeps only the state."""
        self._needs_order("scan_fold")
        step = lambda s, x: column(folder, s, _Element(self.columns, x))
        append = lambda s, x: F.concat(s, F.array(x))
        all_of = self.frame.agg(self._collected(F.lit(True)).alias("items")).withColumn("b", F.greatest(F.ceil(F.sqrt(F.size("items"))), F.lit(1)).cast("int"))
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("items") / F.col("b")) - 1, F.lit(0)).cast("int")), lambda i: F.slice("items", i * F.col("b") + 1, F.col("b")))
        blocks = all_of.select("b", every.alias("blocks"))
        starts = F.aggregate("blocks", F.array(column(seed)), lambda s, block: append(s, F.aggregate(block, F.element_at(s, -1), step)))
        one = blocks.select("b", F.posexplode(F.arrays_zip("blocks", F.slice(starts, 1, F.size("blocks")).alias("starts"))).alias("i", "x"))
        states = F.aggregate("x.blocks", F.array(F.col("x.starts")), lambda s, x: append(s, step(F.element_at(s, -1), x)))
        # only the first block's start is an element of its own
        own = one.withColumn("states", states).select("b", "i", F.when(F.col("i") == 0, F.col("states")).otherwise(F.slice("states", 2, F.size("states"))).alias("states"))
        out = own.select("b", "i", F.posexplode("states").alias("at", "value"))
        return type(self)(out.select((F.col("i").cast("long") * (F.col("b") + 1) + F.col("at")).alias(f"{HIDDEN}0"), "value"), (True,))

    def _with_group(self, p: Expression, small: int | None) -> DataFrame:
        self._needs_order("group_until")
        ends = (~truth(p, self.row)).cast("long")
        return prefix.running(self.frame, self._order(), {"__ended": ("sum", ends)}, exclusive=True, small=prefix.SMALL if small is None else small).withColumn("group", F.coalesce("__ended", F.lit(0)).cast("long")).drop("__ended")

    def group_until(self, inclusive: bool, p: Expression, *, small: int | None = None) -> Self:
        """Arrays ``items`` of consecutive elements for which p is true; one for which it is not closes the group and, if ``inclusive``, belongs to it.  Otherwise a group may be empty; after the last close there is a group only if elements follow."""
        keep = F.lit(True) if inclusive else truth(p, self.row)
        out = self._with_group(p, small).groupBy("group").agg(self._collected(keep).alias("items"))
        return type(self)(out.select(F.col("group").alias(f"{HIDDEN}0"), "group", "items"), (True,))

    def fold_until(self, inclusive: bool, p: Expression, *, small: int | None = None, **folds: Expression | Column) -> Self:
        """As group_until, with aggregates of each group instead of its elements (null in an empty group, counts 0): groups of any size."""
        keep = F.lit(True) if inclusive else truth(p, self.row)
        frame = self._with_group(p, small).withColumn("__keep", keep)
        frame = frame.select("group", *[F.when(F.col("__keep"), self.row[c]).alias(c) for c in self.columns], F.when(F.col("__keep"), True).alias("__member"))
        out = frame.groupBy("group").agg(F.count("__member").alias("size"), *[column(f, self.row).alias(n) for n, f in folds.items()])
        return type(self)(out.withColumn(f"{HIDDEN}0", F.col("group")), (True,))
