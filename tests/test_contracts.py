"""Errors, order, nulls and NaN, sources and sinks, user functions, streaming."""

import io

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corrente import Collector, Desc, EmptyFlow, Flow, NoOrder, NotFound
from corrente import sources as S
from corrente.functions import custom
from corrente.linq import InvalidOperation
from corrente.sources.generate import Unbounded
from corrente.streaming import keyed


def test_errors(spark):
    none = S.empty(spark, "int")
    for call in (none.head, lambda: none.max_by(lambda r: r.value), lambda: none.min_by(lambda r: r.value)):
        with pytest.raises(EmptyFlow):
            call()
    for call in (lambda: none.find(lambda r: r.value > 0), lambda: none.pick(lambda r: r.value)):
        with pytest.raises(NotFound):
            call()
    with pytest.raises(InvalidOperation):
        none.first()
    with pytest.raises(ValueError):
        none.take(-1)
    with pytest.raises(ValueError):
        none.with_degree_of_parallelism(0)
    loose = none.unordered()
    for call in (lambda: loose.mapi(lambda i, r: i), lambda: loose.take_while(lambda r: r.value > 0), lambda: loose.scan("sum", lambda r: r.value, 0), lambda: loose.zip_with(none, lambda a, b: a.value), lambda: loose.group_until(True, lambda r: r.value > 0), loose.ordered):
        with pytest.raises(NoOrder):
            call()
    with pytest.raises(AttributeError):
        none.map(lambda r: r.nothing)


def test_empty_and_single(spark):
    none, one = S.empty(spark, "long"), S.singleton(spark, 4, "long")
    assert (none.sum(), none.length(), none.values(), none.forall(lambda r: r.value > 0), none.exists(lambda r: r.value > 0)) == (0, 0, [], True, False)
    assert none.scan("sum", lambda r: r.value, 3).values() == [3]
    assert none.group_until(True, lambda r: r.value > 0).values() == []
    assert one.scan("count", lambda r: r.value, 0).values() == [0, 1]
    assert none.first_or_default(8) == 8 and one.head().value == 4


def test_ties_take_the_first(spark):
    f = S.of_rows(spark, [(2, "a"), (5, "b"), (5, "c"), (1, "d"), (1, "e")], "k int, v string")
    assert f.max_by(lambda r: r.k).v == "b" and f.min_by(lambda r: r.k).v == "d"
    assert [r.v for r in f.sort_by(lambda r: r.k).to_list()] == ["d", "e", "a", "b", "c"]


def test_null_and_nan_order(spark):
    f = S.of_rows(spark, [1.0, None, float("nan"), -2.0], "double")
    text = lambda rows: [str(x) for x in rows]
    assert text(f.sort_by(lambda r: r.value).values()) == ["None", "-2.0", "1.0", "nan"]
    assert text(f.sort_by_descending(lambda r: r.value).values()) == ["nan", "1.0", "-2.0", "None"]
    assert f.filter(lambda r: r.value > 0).length() == 2  # NaN is the greatest; null is not true
    assert f.sort_by_descending(lambda r: r.value).take_while(lambda r: r.value.isNotNull()).length() == 3
    kept = f.choose(lambda r: r.value, where=lambda r: r.value.isNull() | (r.value < 0)).values()
    assert kept == [None, -2.0]


def test_overflow_and_bad_cast_are_errors(spark):
    with pytest.raises(PySparkException):
        S.of_rows(spark, [2**63 - 1, 1], "long").sum()
    with pytest.raises(PySparkException):
        S.of_rows(spark, ["x"], "string").cast(value="int").values()
    assert S.of_rows(spark, ["7"], "string").cast(value="int").values() == [7]


def test_order_keys(spark):
    f = Flow.over(spark.createDataFrame([(1, "b"), (2, "a"), (2, "c")], "k int, v string"), [Desc("k"), "v"])
    assert [r.v for r in f.to_list()] == ["a", "c", "b"]
    assert f.ordered(lambda r: r.v).map(lambda r: r.v).values() == ["a", "b", "c"]
    assert f.take_while(lambda r: r.v != "c").map(lambda r: r.v).values() == ["a"]
    mixed = f.map(lambda r: {"v": r.v}).concat(S.of_rows(spark, ["x"], "v string"))
    assert mixed.values() == ["a", "c", "b", "x"]
    assert sorted(f.unordered().map(lambda r: r.v).values()) == ["a", "b", "c"]


def test_limits_are_independent_and_caches_whole(spark):
    f = S.of_rows(spark, range(8), "int")
    assert f.take(2).concat(f.take(3)).take(4).values() == [0, 1, 0, 1]
    kept = f.cache()
    assert kept.take(3).values() == [0, 1, 2] and kept.length() == 8
    kept.unpersist()
    assert f.take(0).values() == []


@pytest.mark.parametrize("bounds, broadcast", [(512, 2), (3, 2), (2, 0)])
def test_comparer_over_many_keys(spark, monkeypatch, bounds, broadcast):
    from corrente.operators import limits

    for name, value in (("KEYS_A_BUCKET", 10), ("BOUNDS", bounds), ("BROADCAST_LEVELS", broadcast)):
        monkeypatch.setattr(limits, name, value)
    xs = [(i * 37) % 101 for i in range(300)]
    by = lambda a, b: F.signum((b % 50 - a % 50).cast("double")).cast("int")
    assert S.of_rows(spark, xs, "int").sort_by_using(lambda r: r.value, by).values() == sorted(xs, key=lambda x: -(x % 50))


def test_comparer_keeps_nulls(spark):
    by = lambda a, b: F.signum((b - a).cast("double")).cast("int")
    assert S.of_rows(spark, [1, None, 3, None], "int").sort_by_using(lambda r: r.value, by).values() == [None, None, 3, 1]
    assert S.empty(spark, "int").sort_by_using(lambda r: r.value, by).values() == []


def test_endless(spark):
    squares = S.init_infinite(spark, lambda i: i * i)
    assert squares.take(4).values() == [0, 1, 4, 9]
    assert squares.filter(lambda r: r.value % 3 == 1).map(lambda r: r.value + 1).take(3).values() == [2, 5, 17]
    assert squares.flat_map(lambda r: F.array(r.value, -r.value)).take(3).values() == [0, 0, 1]
    assert squares.find(lambda r: r.value > 5_000_000).value == 2237**2
    assert squares.take_while(lambda r: r.value < 30).length() == 6
    assert S.generate_infinite(spark, lambda: F.lit("x")).take(2).values() == ["x", "x"]
    assert squares.zip_with(S.of_rows(spark, [5, 6], "int"), lambda a, b: a.value + b.value).values() == [5, 7]
    odd = squares.filter(lambda r: r.value % 2 == 1)
    assert squares.zip_with(odd, lambda a, b: b.value - a.value).take(3).values() == [1, 8, 21]
    assert squares.scan("sum", lambda r: r.value, 0).take(5).values() == [0, 0, 1, 5, 14]
    assert squares.map_py(lambda x: x["value"] + 1, "value long").take(3).values() == [1, 2, 5]
    assert squares.try_pick(lambda r: F.when(r.value > 50, -r.value)).value == -64
    counter = S.generate_infinite_py(spark, lambda: iter(range(1, 10**9)).__next__, "value long")
    assert counter.take(3).values() == [1, 2, 3]
    assert counter.filter(lambda r: r.value % 1000 == 0).take(2).values() == [1000, 2000]
    with pytest.raises(Unbounded):
        squares.sum()


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_text_lines(spark, tmp_path, end):
    lines = [f"line {i}" for i in range(20_000)]
    path = tmp_path / "a.txt"
    path.write_bytes(end.join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        f = S.of_text_file_by_line(spark, str(path))
        assert f.frame.rdd.getNumPartitions() > 3
        assert f.values() == lines
        assert f.skip(19_990).values() == lines[19_990:]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert S.of_stream_by_line(spark, io.BytesIO(end.join(lines[:5]).encode())).values() == lines[:5]
    assert S.read_all_text(spark, str(path)).length() == 1


def test_sinks(spark, tmp_path):
    f = S.of_rows(spark, [3, 1, 2], "int").sort_by(lambda r: r.value)
    seen = []
    f.iter(lambda r: seen.append(r.value))
    again = f.to_seq()
    assert seen == [1, 2, 3] == [r.value for r in again] == [r.value for r in again]
    f.write_parquet(str(tmp_path / "p"))
    assert S.read_parquet(spark, str(tmp_path / "p"), order_by="value").values() == [1, 2, 3]
    f.write_text_lines(str(tmp_path / "t"))
    assert S.of_text_file_by_line(spark, str(tmp_path / "t")).values() == ["1", "2", "3"]
    assert "ordered" in repr(f)
    f.unordered().iter_partitions(lambda rows: None)


def test_other_names(spark):
    f = S.of_rows(spark, [1, 2, 3, 4], "int")
    assert f.where(lambda r: r.value > 1).select(lambda r: r.value * 10).to_list()[0].value == 20
    assert f.select_many(lambda r: F.array(r.value, r.value)).count() == 8
    assert f.order_by_descending(lambda r: r.value).first().value == 4
    assert f.any(lambda r: r.value == 3) and not f.all(lambda r: r.value == 3)
    assert f.first(lambda r: r.value > 2).value == 3 and f.first_where_or_default(lambda r: r.value > 9, 0) == 0
    assert f.zip(f, lambda a, b: a.value + b.value).values() == [2, 4, 6, 8]
    assert f.aggregate(total=lambda r: F.sum(r.value)) == 10
    assert [tuple(r) for r in f.aggregate_by(lambda r: r.value % 2, n=lambda r: F.count("*")).to_list()] == [(1, 2), (0, 2)]


def test_python_functions(spark):
    f = S.of_rows(spark, range(10), "long")
    assert f.map_py(lambda x: x["value"] * 2, "value long").values() == [2 * i for i in range(10)]
    assert f.filter_py(lambda x: x["value"] > 7).values() == [8, 9]
    assert f.map_udf(custom.scalar(lambda x: x + 1, "long"), "value").values() == list(range(1, 11))

    class Mean(Collector):
        def init(self):
            return (0, 0)

        def update(self, state, batch):
            return state[0] + int(batch["value"].sum()), state[1] + len(batch)

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1]

        def result(self, state):
            return state[0] / state[1] if state[1] else 0.0

    assert f.apply(Mean()) == 4.5
    assert f.fold_parallel_py(Mean()).first()[0] == 4.5
    assert S.empty(spark, "long").apply(Mean()) == 0.0
    wide = Flow.over(spark.range(0, 1000, 1, 200))
    assert wide.map(lambda r: {"value": r.id}).apply(Mean()) == 499.5


def test_streams(spark, tmp_path):
    for i in range(3):
        pd.DataFrame({"k": ["a", "b"], "x": [i, 10 * i], "at": [2 * i, 2 * i + 1]}).to_parquet(tmp_path / f"{i}.parquet")
    stream = keyed.replay(spark, str(tmp_path), "k string, x long, at long")
    doubled = Flow.over(stream).filter(lambda r: r.x > 0).map(lambda r: {"y": r.x * 2})
    folded = keyed.fold_by_stream(stream, lambda r: r.k, lambda s, e: s + e[1], lambda: 0, "long", "at")
    for name, df, mode in (("doubled", doubled.df, "append"), ("folded", folded, "update"), ("counted", keyed.count_by_stream(stream, lambda r: r.k), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.y for r in spark.table("doubled").collect()) == [2, 4, 20, 40]
    assert {r.key: r.v for r in spark.sql("select key, max(value) v from folded group by key").collect()} == {"a": 3, "b": 30}
    assert {r.key: r["count"] for r in spark.table("counted").collect()} == {"a": 3, "b": 3}


def test_null_keys_find_nothing_in_another_flow(spark):
    a, b = S.of_rows(spark, [1, None, 2, 2, 5], "int"), S.of_rows(spark, [2, None, 7], "int")
    on = lambda x, y: x.value == y.value
    assert a.exists_in(b, on).values() == [2, 2]
    assert a.exists_in(b, on, negate=True).values() == [1, None, 5]
    assert a.exists_in(b, lambda x, y: x.value < y.value, negate=True).values() == [None]
    assert a.exists_in(b, lambda x, y: x.value.eqNullSafe(y.value), negate=True).values() == [1, 5]
    assert a.exists_in(S.empty(spark, "int"), on, negate=True).values() == [1, None, 2, 2, 5]
