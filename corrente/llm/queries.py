"""The queries of this subpackage: each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, lmscore, mixing, neardup, quality, secrets, sharding, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_prob_minhash": lambda s, d: neardup.report(table(s, d, "documents")),
        "op2_entropy_mix": lambda s, d: mixing.mix_report(table(s, d, "documents")),
        "op3_ring_shards": lambda s, d: sharding.shard_report(table(s, d, "documents")),
        "op4_importance_quality": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
        "op5_secret_automaton": lambda s, d: secrets.report(table(s, d, "documents")),
        "op6_prefix_decontamination": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_language_family": lambda s, d: langid.report(table(s, d, "documents")),
        "op8_pivot_topk": lambda s, d: topk.report(table(s, d, "embeddings")),
        "op9_toxic_segments": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
        "op10_bloom_lm": lambda s, d: lmscore.report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_prefix_decontamination": decontaminate.ORACLE_SQL, "op8_pivot_topk": topk.ORACLE_SQL}
