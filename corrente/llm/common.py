"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import os
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.durable import materialised as materialised
from ..plans.durable import removed as removed
from ..plans.durable import shared_folder as shared_folder

#: Bytes and rows that one Arrow batch brings to a Python worker at most (one row may be longer).
ARROW_BYTES, ARROW_ROWS = 16 << 20, 4000
_ROOT = str(Path(__file__).resolve().parents[2])


def arrow_limits(spark: SparkSession) -> None:
    """Keeps a batch of long texts from filling a Python worker; a smaller limit that the session has stays."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        have = spark.conf.get(key, None)
        if have is None or not have.lstrip("-").isdigit() or not 0 < int(have) <= value:
            spark.conf.set(key, str(value))
    if spark.sparkContext.master.startswith("local"):
        # workers on this machine find the package where the driver found it; a cluster gets it by --py-files
        env = spark.sparkContext.environment
        if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def order_hash(*columns: Column | str, seed: str) -> Column:
    """A fixed pseudo-random long of the columns."""
    return F.xxhash64(F.lit(seed), *columns)


def named(column: str, of: str = "") -> Column:
    """A column by its exact name, which may hold dots and backticks; ``of``: the struct that it is a field of."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def packed_rows(docs: DataFrame, row: str = "row", **roles: str | Column) -> DataFrame:
    """Whole rows as one struct beside the columns that an operator works on, so that no name of theirs meets one of its own."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias(row), *[(named(c) if isinstance(c, str) else c).alias(r) for r, c in roles.items()])


def own_columns(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``docs`` again, out of the struct."""
    return [named(c, row).alias(c) for c in docs.columns]


def added(have: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until it is none of those in use."""
    have = {c.lower() for c in have}
    while name.lower() in have:
        name = "_" + name
    return name


def unused(df: DataFrame, name: str) -> str:
    return added(df.columns, name)



#: Keys (two longs each) up to this number are broadcast; more are joined by shuffling.
BROADCAST_KEYS = 500_000


def row_key(*columns: Column) -> list[Column]:
    """Two longs that tell rows apart by these columns, nulls included: hashes of 64 bits with unlike seeds."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in ("first", "second")]


def _joined(docs: DataFrame, keys: DataFrame, by: list[Column], how: str) -> DataFrame:
    own, other = [unused(docs, x) for x in ("own_a", "own_b")], [unused(docs, x) for x in ("key_a", "key_b")]
    keys = materialised(keys.toDF(*other).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    marked = docs.select("*", *[c.alias(n) for c, n in zip(by, own, strict=True)])
    both = marked.join(keys, (F.col(own[0]) == F.col(other[0])) & (F.col(own[1]) == F.col(other[1])), how)
    return both.select(*[named(c) for c in docs.columns])


def without(docs: DataFrame, keys: DataFrame, by: list[Column]) -> DataFrame:
    """The rows whose ``row_key`` (the columns ``by``) is not among ``keys``: whole texts move only beyond ``BROADCAST_KEYS``."""
    return _joined(docs, keys, by, "left_anti")


def within(docs: DataFrame, keys: DataFrame, by: list[Column]) -> DataFrame:
    return _joined(docs, keys, by, "left_semi")


def give_back() -> None:
    """At the end of a task in a Python worker, which lives on: memory that it does not hold any more goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def over_batches(docs: DataFrame, keep: Sequence[str], inputs: Sequence[Column], work: Callable[..., list[pa.Array]], fields: str) -> DataFrame:
    """The ``keep`` columns beside those that work gives for the Arrow arrays of ``inputs``; fields: names and kinds of these as DDL.  Kept columns pass under other names, so theirs may be any."""
    k = len(keep)
    slim = docs.select(*[named(c).alias(f"__kept{i}") for i, c in enumerate(keep)], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    more = StructType.fromDDL(fields).fields
    names = [*slim.columns[:k], *[f.name for f in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *work(*batch.columns[k:])], names=names)
        give_back()

    out = slim.mapInArrow(run, StructType([*slim.schema.fields[:k], *more]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=False)], *[F.col(f.name).alias(added(keep, f.name)) for f in more])


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone: its cleaner waits for a garbage collection of the driver, which an idle heap puts off while disks fill."""
    gc.collect()
    time.sleep(0.3)  # until the JVM has learned what Python let go of
    spark.sparkContext._jvm.System.gc()
