"""Intermediate results that survive lost executors, and the estimated size of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: the folder that the session names in spark.checkpoint.dir.  A session on one machine without that setting (tests) gets a temporary folder, removed at exit; on a cluster its absence is an error, as executors do not see each other's local folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="corrente-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark's file systems reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialised(df: DataFrame) -> DataFrame:
    """Cuts the lineage through checkpoint files in the shared folder, so a lost executor costs no recomputation from the source."""
    shared_folder(df.sparkSession)
    # a frame over the stored rows alone: the plan before it would pass on its estimated size, and that of a join is a product, so rounds of joins would reach numbers that fill the driver
    stored = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(stored.queryExecution().logical().rdd(), stored.schema(), False), df.sparkSession)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a result; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
