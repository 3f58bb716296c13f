import math

import numpy as np
import pytest

from corrente.llm import topk


def brute(rows, is_query, k):
    """Row against row: a query leaves out its own row only."""
    some = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(some):
        if q is not None and is_query(q):
            found = [(-sum(x * y for x, y in zip(v, w, strict=True)), c is None, c or 0) for b, (c, w) in enumerate(some) if a != b and len(w) == len(v)]
            out += [(q, rank, None if none else c, -s) for rank, (s, none, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(330, 8)).round(3)
    out = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    out += [(1000 + i, out[3][1]) for i in range(60)]  # a vector that many share
    out += [(2000, None), (2050, [float("nan")] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("inf")] * 8), (None, out[1][1]), (2200, [0.0] * 8), (2250, [1.0, 2.0]), (2251, [3.0, 1.0]), (2300, []), (50, out[50][1]), (50, out[50][1]), (50, out[51][1]), (100, out[100][1]), (1, out[1][1]), (1, out[1][1]), (None, out[1][1])]
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, `a.b` string")
    got = sorted(map(tuple, topk.report(frame).collect()), key=str)
    assert got == brute(rows, lambda q: q % 50 == 0, 5)


def test_sql_agrees_on_repeated_rows_and_null_ids(spark, rows):
    import duckdb
    import pandas as pd

    same = [(i, v) for i, v in rows if v is None or len(v) == 8]
    embeddings = pd.DataFrame(same, columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"})  # noqa: F841
    want = duckdb.sql(topk.ORACLE_SQL).fetchall()
    frame = spark.createDataFrame(same, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.report(frame).collect()), key=str) == sorted(want, key=str)


def test_far_annuli_are_left_out(spark, monkeypatch):
    """Clusters far apart: the bounds skip most blocks, and nothing is lost."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 6
    rows = [(i, [float(x) for x in (centres[i % 40] / np.linalg.norm(centres[i % 40]) * 10 + rng.normal(size=6) * 0.02).round(3)]) for i in range(1600)]
    stats = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, frame.vec_id % 50 == 0, stats=stats).collect()), key=str)
    assert got == brute(rows, lambda q: q % 50 == 0, 5)
    assert stats["visited"] < 0.5 * stats["pairs"], stats


def test_empty(spark):
    assert topk.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
