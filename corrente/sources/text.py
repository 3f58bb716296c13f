"""Lines of text.  LF, CR and CRLF end a line; files are split, and read in parallel."""

from __future__ import annotations

from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..flow import Flow
from ..functions.rows import HIDDEN
from .memory import of_rows


def of_text_file_by_line(spark: SparkSession, *paths: str) -> Flow:
    """Column ``value``, in the order of files by name and of lines in them.  The ids of rows ascend within a split, whose file and place order the splits."""
    lines = spark.read.text(list(paths))
    order = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return Flow(lines.select("value", *[c.alias(f"{HIDDEN}{i}") for i, c in enumerate(order)]), (True, True, True))


def of_stream_by_line(spark: SparkSession, stream: IO[bytes], encoding: str = "utf-8") -> Flow:
    """The lines of an open binary stream of the driver, which is closed."""
    with stream:
        text = stream.read().decode(encoding)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return of_rows(spark, lines, "string")


def read_all_text(spark: SparkSession, *paths: str) -> Flow:
    """Column ``value``: each file as one element."""
    files = spark.read.text(list(paths), wholetext=True)
    return Flow(files.select("value", F.col("_metadata.file_path").alias(f"{HIDDEN}0")), (True,))
