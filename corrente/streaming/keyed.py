"""Running folds by key over an unbounded DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..flow import Flow
from ..functions.rows import Expression, column


def replay(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def count_by_stream(stream: DataFrame, key: Expression) -> DataFrame:
    """Columns key and count, for output mode complete or update: partial counts in each task."""
    flow = Flow(stream)
    return stream.groupBy(column(key, flow.row).alias("key")).agg(F.count("*").alias("count"))


def count_by_window(stream: DataFrame, time: str, late: str, width: str, key: Expression) -> DataFrame:
    """Counts by key and event-time window; rows later than ``late`` are dropped, so that state stays bounded."""
    flow = Flow(stream)
    return stream.withWatermark(time, late).groupBy(F.window(time, width), column(key, flow.row).alias("key")).agg(F.count("*").alias("count"))


def fold_by_stream(stream: DataFrame, key: Expression, folder: Callable[[Any, tuple], Any], init: Callable[[], Any], kind: str, order: str) -> DataFrame:
    """Columns key and value: folder(state, element) of each key, continued from batch to batch; within a batch by the column ``order``.  For output mode update.  ``kind``: type of the state, which Spark keeps in its state store."""
    flow = Flow(stream)
    names = stream.columns
    keyed = stream.withColumn("__key", column(key, flow.row))
    key_kind = keyed.schema["__key"].dataType.simpleString()

    def work(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else init()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for values in rows[names].itertuples(index=False, name=None):
            now = folder(now, values)
        state.update((now,))
        yield pd.DataFrame({"key": [k[0]], "value": [now]})

    return keyed.groupBy("__key").applyInPandasWithState(work, f"key {key_kind}, value {kind}", f"value {kind}", "update", GroupStateTimeout.NoTimeout)
