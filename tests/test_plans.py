"""Plans: what is pushed down, pruned and not shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from corrente import Flow
from corrente import queries as Q
from corrente import sources as S
from corrente.plans import inspect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def lineitem(spark):
    return S.read_parquet(spark, f"{SF}/lineitem.parquet", order_by=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def test_filters_and_columns_reach_the_scan(lineitem):
    df = lineitem.filter(lambda r: r.l_quantity < 24).map(lambda r: F.round(r.l_extendedprice * 100).cast("long")).sum_df()
    assert "l_quantity" in inspect.pushed_filters(df)
    assert inspect.read_columns(df) == {"l_quantity", "l_extendedprice"}
    assert not re.search("Python|Arrow", inspect.physical(df))


def test_sort_and_take_are_a_top_k(lineitem):
    df = lineitem.top(5, lambda r: r.l_extendedprice).map(lambda r: {"p": r.l_extendedprice}).df
    assert "TakeOrderedAndProject" in inspect.physical(df)
    assert not [x for x in inspect.operators(df) if x == "Exchange"]


def test_skip_and_take_are_one_top_k(lineitem):
    assert "TakeOrderedAndProject" in inspect.physical(lineitem.skip(7).take(5).df)


def test_unordered_maps_do_not_shuffle(lineitem):
    df = lineitem.filter(lambda r: r.l_quantity < 24).map(lambda r: {"p": r.l_extendedprice}).df
    assert inspect.exchanges(df) == 0
    assert inspect.read_columns(df) == {"l_quantity", "l_extendedprice"}


def test_large_plans_have_no_single_task(lineitem):
    df = lineitem.scan("sum", lambda r: F.round(r.l_quantity).cast("long"), 0, small=0).df
    windows = [x for x in inspect.physical(df).splitlines() if "SinglePartition" in x]
    # the only gathering is of one row a range
    assert len(windows) <= 1


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_every_query_runs(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns and len(df.collect()) >= 0


def test_core_does_not_need_the_language_model_package():
    import pathlib

    root = pathlib.Path(Q.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_searches_in_another_flow_compare_no_pairs(spark):
    for name in ("filter_exists", "filter_not_exists"):
        assert "NestedLoop" not in inspect.physical(Q.queries()[name](spark, SF)), name


def test_few_bytes_of_many_rows_are_numbered_by_ranges(spark, monkeypatch):
    from corrente.plans import prefix

    monkeypatch.setattr(prefix, "ROWS", 1000, raising=False)
    order = [F.col("k")]
    # an array's entries, which the estimate of bytes does not know of, and few rows
    many = Flow.over(spark.range(2999, 3000)).flat_map(lambda r: F.sequence(F.lit(0).cast("long"), r.id)).frame.select(F.col("value").alias("k"))
    few = many.where("k < 1000")
    assert prefix.estimated_bytes(many) < prefix.SMALL
    out = prefix.indexed(many, order, "at")
    assert "row_number" not in inspect.physical(out) and "row_number" in inspect.physical(prefix.indexed(few, order, "at"))
    parts = out.where("k = at").select("k", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 3 and sum(r["count"] for r in parts) == 3000 and max(r["count"] for r in parts) < 2000
    down = S.of_rows(spark, range(3000), "long").sort_by_descending(lambda r: r.value)
    assert sorted(down.skip(2990).values()) == list(range(10))
    assert down.mapi(lambda i, r: r.value + i).map(lambda r: {"value": r.value}).frame.select("value").distinct().collect() == [(2999,)]


def test_ranges_follow_rows_and_bytes(spark, monkeypatch):
    from corrente.plans import prefix

    df = spark.range(100)
    for rows, size, expect in ((100, 800, 0), (99, 800, 2), (10, 800, 10), (100, 100, 8), (10, 1, 50)):
        for name, value in (("ROWS", rows), ("SMALL", size), ("LEAST_ROWS", 2)):
            monkeypatch.setattr(prefix, name, value)
        assert prefix._ranges(df, size) == expect, (rows, size)
    monkeypatch.setattr(prefix, "estimated_bytes", lambda df: 2**63)
    assert prefix._ranges(df, 1) == 10  # rows alone; 2 * 16 rows a range would be fewer


def test_few_bytes_of_many_rows_are_summed_up_by_ranges(spark, monkeypatch):
    from corrente.plans import prefix

    monkeypatch.setattr(prefix, "ROWS", 1000, raising=False)
    many = Flow.over(spark.range(5999, 6000), "id").flat_map(lambda r: F.sequence(F.lit(0).cast("long"), r.id))
    frame = many.frame.select(F.col("value").alias("k"))
    out = prefix.running(frame, [F.col("k")], {"s": ("sum", F.col("k"))}, exclusive=True).select("*", F.spark_partition_id().alias("p"))
    rows = out.collect()
    assert {r.k: r.s for r in rows} == {k: k * (k - 1) // 2 if k else None for k in range(6000)}
    in_a_task = [sum(r.p == p for r in rows) for p in {r.p for r in rows}]
    assert len(in_a_task) == 6 and max(in_a_task) < 2000
    for inclusive in (True, False):
        sizes = many.fold_until(inclusive, lambda r: r.value % 7 != 6, last=lambda r: F.max(r.value)).df.orderBy("group").collect()
        assert [r["size"] for r in sizes] == [7 if inclusive else 6] * 857 + [1] and sizes[-1]["last"] == 5999
    assert [r.n for r in many.group_until(True, lambda r: r.value % 7 != 6).map(lambda r: {"n": F.size(r["items"])}).to_list()] == [7] * 857 + [1]


def test_groups_of_many_rows_are_cut_by_ranges(spark, monkeypatch):
    from corrente.plans import prefix

    monkeypatch.setattr(prefix, "ROWS", 1000, raising=False)
    many = Flow.over(spark.range(2999, 3000), "id").flat_map(lambda r: F.sequence(F.lit(0).cast("long"), r.id))
    assert "__row_part" in inspect.physical(many.group_until(True, lambda r: r.value % 7 != 6).df)
