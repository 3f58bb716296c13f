"""First matches and quantifiers.  A match in an ordered flow is the first; else it is any."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Row as Record
from pyspark.sql import functions as F

from ..functions.rows import Expression, truth
from .base import EmptyFlow, NotFound
from .limits import Limits
from .project import Project


class Search(Project, Limits):
    def try_head_df(self) -> DataFrame:
        return self.take(1).df

    def try_head(self) -> Record | None:
        return next(iter(self.try_head_df().take(1)), None)

    def head(self) -> Record:
        found = self.try_head()
        if found is None:
            raise EmptyFlow("head of an empty flow")
        return found

    def try_find_df(self, p: Expression) -> DataFrame:
        return self.filter(p).take(1).df

    def try_find(self, p: Expression) -> Record | None:
        return self.filter(p).try_head()

    def find(self, p: Expression) -> Record:
        return _found(self.try_find(p), "find")

    def try_pick_df(self, f: Expression, where: Expression | None = None) -> DataFrame:
        return self.choose(f, where).take(1).df

    def try_pick(self, f: Expression, where: Expression | None = None) -> Record | None:
        """What f gives for the first element for which it is not null (``where``: for which that is true)."""
        return self.choose(f, where).try_head()

    def pick(self, f: Expression, where: Expression | None = None) -> Record:
        return _found(self.try_pick(f, where), "pick")

    def first_or_default_df(self, default: dict[str, Any] | None = None) -> DataFrame:
        """The first element, or one of ``default`` values (null where none is given)."""
        default = default or {}
        head = self.take(1).df.select(F.lit(0).alias("__rank"), *self._payload())
        kinds = {s.name: s.dataType for s in head.schema}
        other = self.spark.range(1).select(F.lit(1).alias("__rank"), *[F.lit(default.get(c)).cast(kinds[c]).alias(c) for c in self.columns])
        return head.unionByName(other).orderBy("__rank").limit(1).drop("__rank")

    def first_or_default(self, default: Any = None) -> Any:
        found = self.try_head()
        return default if found is None else found

    def exists_df(self, p: Expression) -> DataFrame:
        # one matching row decides, so the scan can stop there
        return self.spark.range(1).select(F.lit(True).alias("__row")).join(self.df.where(truth(p, self.row)).limit(1).select(F.lit(True).alias("__hit")), F.lit(True), "left").select(F.col("__hit").isNotNull().alias("value"))

    def exists(self, p: Expression) -> bool:
        return not self.filter(p).frame.isEmpty()

    def forall_df(self, p: Expression) -> DataFrame:
        return self.exists_df(lambda r: ~truth(p, r)).select((~F.col("value")).alias("value"))

    def forall(self, p: Expression) -> bool:
        """True for an empty flow."""
        return not self.exists(lambda r: ~truth(p, r))

    def is_empty_df(self) -> DataFrame:
        return self.exists_df(lambda r: F.lit(True)).select((~F.col("value")).alias("value"))

    def is_empty(self) -> bool:
        return self.frame.isEmpty()


def _found(x: Record | None, what: str) -> Record:
    if x is None:
        raise NotFound(f"{what}: no element fits")
    return x
