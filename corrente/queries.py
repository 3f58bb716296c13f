"""One query for each operator of a flow, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as S
from .flow import Flow
from .functions import custom
from .operators.custom import Collector
from .plans.durable import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(name: str, order_by: object = None) -> Callable[[SparkSession, str], Flow]:
    return lambda spark, d: S.read_parquet(spark, f"{d}/{name}.parquet", order_by=order_by)


_orders = _table("orders", "o_orderkey")
_events = _table("events", "event_id")
_lineitem = _table("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
_customer, _supplier = _table("customer", "c_custkey"), _table("supplier", "s_suppkey")
_cents = lambda x: F.round(x * 100).cast("long")
_CENTS = "cast(round({} * 100) as bigint)"
_EVENT_CENTS = _CENTS.format("value")


# projection and filters


@_query("map_project", "select o_orderkey, o_custkey + 1 next_cust from orders")
def map_project(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_orderkey": r.o_orderkey, "next_cust": r.o_custkey + 1}).df


@_query("filter_even", "select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0")
def filter_even(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(lambda r: r.o_orderkey % 2 == 0).map(lambda r: {"o_orderkey": r.o_orderkey, "o_totalprice": r.o_totalprice}).df


@_query("choose_high", "select o_orderkey * 2 as value from orders where o_totalprice > 200000")
def choose_high(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).choose(lambda r: F.when(r.o_totalprice > 200000, r.o_orderkey * 2)).df


@_query("choose_labelled", "select d.doc_id, l.quality from documents d join labels l using (doc_id) where l.quality is not null")
def choose_labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = _table("labels")(spark, d)
    return _table("documents")(spark, d).flat_map_flow(labels, lambda a, b: {"quality": b.quality, "doc_id": a.doc_id}, on=lambda a, b: a.doc_id == b.doc_id).choose(lambda r: {"quality": r.quality, "doc_id": r.doc_id}).df


@_query("mapi_index", "select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) idx from orders where o_orderstatus = 'F'")
def mapi_index(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(lambda r: r.o_orderstatus == "F").mapi(lambda i, r: {"o_orderkey": r.o_orderkey, "idx": i}).df


@_query("mapi_two_phase", "select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) idx from orders")
def mapi_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """The plan of large inputs."""
    return _orders(spark, d).mapi(lambda i, r: {"o_orderkey": r.o_orderkey, "idx": i}, small=0).df


@_query("flatmap_words", "select doc_id, unnest(string_split(text, ' ')) word from documents")
def flatmap_words(spark: SparkSession, d: str) -> DataFrame:
    docs = _table("documents", "doc_id")(spark, d)
    return docs.flat_map(lambda r: F.transform(F.split(r.text, " "), lambda w: F.struct(r.doc_id.alias("doc_id"), w.alias("word")))).df


@_query("flatmap_range", "select p_partkey, unnest(range(1, p_size + 1)) as i from part")
def flatmap_range(spark: SparkSession, d: str) -> DataFrame:
    part = _table("part", "p_partkey")(spark, d)
    numbers = lambda r: F.when(r.p_size >= 1, F.sequence(F.lit(1), r.p_size)).otherwise(F.array().cast("array<int>"))
    return part.flat_map(lambda r: F.transform(numbers(r), lambda i: F.struct(r.p_partkey.alias("p_partkey"), i.cast("long").alias("i")))).df


@_query("flatmap_embedding", "select vec_id, cast(i as bigint) place, cast(embedding[i + 1] as double) x from (select vec_id, embedding, unnest(range(0, len(embedding))) i from embeddings)")
def flatmap_embedding(spark: SparkSession, d: str) -> DataFrame:
    vectors = _table("embeddings", "vec_id")(spark, d)
    return vectors.flat_map(lambda r: F.transform(r.embedding, lambda x, i: F.struct(r.vec_id.alias("vec_id"), i.cast("long").alias("place"), x.cast("double").alias("x")))).df


@_query("flatmap_cross", "select n_name, r_name from nation cross join region")
def flatmap_cross(spark: SparkSession, d: str) -> DataFrame:
    return _table("nation", "n_nationkey")(spark, d).flat_map_flow(_table("region", "r_regionkey")(spark, d), lambda a, b: {"n_name": a.n_name, "r_name": b.r_name}).df


@_query("flatmap_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000")
def flatmap_join(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(lambda r: r.o_totalprice > 100000).flat_map_flow(_customer(spark, d), lambda a, b: {"o_orderkey": a.o_orderkey, "c_name": b.c_name}, on=lambda a, b: a.o_custkey == b.c_custkey).df


@_query("filter_exists", "select c_custkey, c_name from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def filter_exists(spark: SparkSession, d: str) -> DataFrame:
    big = _orders(spark, d).filter(lambda r: r.o_totalprice > 300000)
    return _customer(spark, d).exists_in(big, lambda a, b: a.c_custkey == b.o_custkey).map(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name}).df


@_query("filter_not_exists", "select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def filter_not_exists(spark: SparkSession, d: str) -> DataFrame:
    big = _orders(spark, d).filter(lambda r: r.o_totalprice > 300000)
    return _customer(spark, d).exists_in(big, lambda a, b: a.c_custkey == b.o_custkey, negate=True).map(lambda r: {"c_custkey": r.c_custkey}).df


@_query("cast_column", "select event_id, cast(value as varchar) is not null has_text, cast(floor(value) as bigint) whole from events")
def cast_column(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"event_id": r.event_id, "has_text": r.value.cast("string").isNotNull(), "whole": F.floor(r.value)}).cast(whole="long").df


# limits and sorts


@_query("take_ordered", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
def take_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).take(25).map(lambda r: {"o_orderkey": r.o_orderkey, "o_totalprice": r.o_totalprice}).df


@_query("take_unordered", "select least(count(*), 100) as value from orders")
def take_unordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).unordered().take(100).length_df()


@_query("skip_ordered", "select o_orderkey from orders order by o_orderkey offset 100")
def skip_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_orderkey": r.o_orderkey}).skip(100).df


@_query("skip_unordered", "select greatest(count(*) - 100, 0) as value from orders")
def skip_unordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).unordered().skip(100).length_df()


@_query("skip_take", "select o_orderkey from orders order by o_orderkey limit 20 offset 50")
def skip_take(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).skip(50).take(20).map(lambda r: {"o_orderkey": r.o_orderkey}).df


@_query("take_while", "select event_id, event_type from events where event_id < coalesce((select min(event_id) from events where not value < 40), 9223372036854775807)")
def take_while(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).take_while(lambda r: r.value < 40).map(lambda r: {"event_id": r.event_id, "event_type": r.event_type}).df


_rank = lambda i, r: {"o_orderkey": r.o_orderkey, "rank": i}


@_query("sort_by", "select o_orderkey, cast(row_number() over (order by o_totalprice, o_orderkey) - 1 as bigint) as rank from orders")
def sort_by(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).sort_by(lambda r: r.o_totalprice).mapi(_rank).df


@_query("sort_by_desc", "select o_orderkey, cast(row_number() over (order by o_orderdate desc, o_orderkey) - 1 as bigint) as rank from orders")
def sort_by_desc(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).sort_by_descending(lambda r: r.o_orderdate).mapi(_rank).df


@_query("sort_by_using", "select o_orderkey, cast(row_number() over (order by o_custkey % 7 desc, o_custkey, o_orderkey) - 1 as bigint) as rank from orders")
def sort_by_using(spark: SparkSession, d: str) -> DataFrame:
    def compare(a, b):  # noqa: ANN001, ANN202
        return F.when(a % 7 != b % 7, F.signum((b % 7 - a % 7).cast("double")).cast("int")).otherwise(F.signum((a - b).cast("double")).cast("int"))

    return _orders(spark, d).sort_by_using(lambda r: r.o_custkey, compare).mapi(_rank).df


@_query("top_k", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_partkey, l_suppkey, l_linenumber limit 100")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return _lineitem(spark, d).top(100, lambda r: r.l_extendedprice).map(lambda r: {n: r[n] for n in names}).df


# several inputs


@_query("zip_with", """
with a as (select o_orderkey, row_number() over (order by o_orderkey) i from orders), b as (select event_id, row_number() over (order by event_id) i from events)
select o_orderkey, event_id from a join b using (i)""")  # fmt: skip
def zip_with(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).zip_with(_events(spark, d), lambda a, b: {"o_orderkey": a.o_orderkey, "event_id": b.event_id}).df


@_query("concat", "select c_custkey as k, c_name as name, 0 as part from customer union all select s_suppkey, s_name, 1 from supplier")
def concat(spark: SparkSession, d: str) -> DataFrame:
    a = _customer(spark, d).map(lambda r: {"k": r.c_custkey, "name": r.c_name})
    return a.concat(_supplier(spark, d).map(lambda r: {"k": r.s_suppkey, "name": r.s_name}), ordinal="part").df


@_query("of_seqs", "select n_name as name from nation union all select r_name from region union all select n_name from nation")
def of_seqs(spark: SparkSession, d: str) -> DataFrame:
    nation, region = _table("nation")(spark, d).map(lambda r: {"name": r.n_name}), _table("region")(spark, d).map(lambda r: {"name": r.r_name})
    return S.of_seqs(spark, [nation, region, nation], "name string").df


# folds


@_query("fold_algebraic", f"select sum({_CENTS.format('l_extendedprice')})::bigint total, count(*) n, min(l_shipdate) first_day, max(l_quantity) most from lineitem where l_discount > 0.05")
def fold_algebraic(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).filter(lambda r: r.l_discount > 0.05).fold_df(total=lambda r: F.sum(_cents(r.l_extendedprice)), n=lambda r: F.count("*"), first_day=lambda r: F.min(r.l_shipdate), most=lambda r: F.max(r.l_quantity))


@_query("fold_ordered", f"select list_reduce(list_prepend(cast(7 as bigint), list({_EVENT_CENTS} order by event_id)), lambda s, c: (s * 31 + c) % 1000003) as value from events")
def fold_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"c": _cents(r.value)}).fold_ordered_df(lambda s, x: (s * 31 + x.c) % 1000003, F.lit(7).cast("long"))


@_query("fold_parallel", f"select sum({_CENTS.format('l_extendedprice')})::bigint as value from lineitem")
def fold_parallel(spark: SparkSession, d: str) -> DataFrame:
    class Cents(Collector):
        def init(self) -> int:
            return 0

        def update(self, state: int, batch: pd.DataFrame) -> int:
            return state + int(batch["c"].sum())

        def merge(self, a: int, b: int) -> int:
            return a + b

    return _lineitem(spark, d).map(lambda r: {"c": _cents(r.l_extendedprice)}).unordered().fold_parallel_py(Cents(), "value long")


@_query("sum", f"select sum({_CENTS.format('l_extendedprice * (1 - l_discount)')})::bigint as value from lineitem where l_quantity < 24")
def sum_revenue(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).filter(lambda r: r.l_quantity < 24).map(lambda r: _cents(r.l_extendedprice * (1 - r.l_discount))).sum_df()


@_query("length", "select count(*) as value from lineitem where l_returnflag = 'R'")
def length(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).filter(lambda r: r.l_returnflag == "R").length_df()


@_query("max_by", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 1")
def max_by(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_orderkey": r.o_orderkey, "o_orderdate": r.o_orderdate}).max_by_df(lambda r: r.o_orderdate)


@_query("min_by", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 1")
def min_by(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_orderkey": r.o_orderkey, "o_orderdate": r.o_orderdate}).min_by_df(lambda r: r.o_orderdate)


# folds by key


@_query("fold_by", f"select event_type as key, sum({_EVENT_CENTS})::bigint total, max(ts) latest, count(*) n from events group by all")
def fold_by(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).fold_by(lambda r: r.event_type, total=lambda r: F.sum(_cents(r.value)), latest=lambda r: F.max(r.ts), n=lambda r: F.count("*")).df


@_query("fold_by_ordered", f"select user_id as key, list_reduce(list_prepend(cast(7 as bigint), list({_EVENT_CENTS} order by event_id)), lambda s, c: (s * 31 + c) % 1000003) as value from events group by user_id")
def fold_by_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"user_id": r.user_id, "c": _cents(r.value)}).fold_by_ordered(lambda r: r.user_id, lambda s, x: (s * 31 + x.c) % 1000003, F.lit(7).cast("long")).df


@_query("fold_conversation", "select conv_id as key, string_agg(role || ':' || length(text), '|' order by turn) as value from conversations group by conv_id")
def fold_conversation(spark: SparkSession, d: str) -> DataFrame:
    turns = _table("conversations", ["conv_id", "turn"])(spark, d).map(lambda r: {"conv_id": r.conv_id, "said": F.concat(r.role, F.lit(":"), F.length(r.text).cast("string"))})
    return turns.fold_by_ordered(lambda r: r.conv_id, lambda s, x: F.when(s == "", x.said).otherwise(F.concat(s, F.lit("|"), x.said)), F.lit("")).df


@_query("group_by_list", "select user_id as key, array_to_string(list(event_id order by event_id), ',') as items from events group by user_id")
def group_by_list(spark: SparkSession, d: str) -> DataFrame:
    groups = _events(spark, d).map(lambda r: {"user_id": r.user_id, "event_id": r.event_id}).group_by(lambda r: r.user_id)
    return groups.map(lambda r: {"key": r.key, "items": F.array_join(F.transform(r["items"], lambda x: x.event_id.cast("string")), ",")}).df


@_query("count_by", "select l_returnflag as key, count(*) as count from lineitem group by all")
def count_by(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).unordered().count_by(lambda r: r.l_returnflag).df


@_query("count_by_first_seen", "select key, cast(row_number() over (order by first) - 1 as bigint) place, count from (select event_type as key, min(event_id) as first, count(*) as count from events group by all)")
def count_by_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).count_by(lambda r: r.event_type).mapi(lambda i, r: {"key": r.key, "place": i, "count": r["count"]}).df


_GROUPS = f"select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (order by event_id rows between unbounded preceding and 1 preceding), 0) g, {_EVENT_CENTS} c from events"


@_query("group_until_incl", f'select cast(g as bigint) as "group", count(*) as n, sum(c)::bigint as total from ({_GROUPS}) group by g')
def group_until_incl(spark: SparkSession, d: str) -> DataFrame:
    groups = _events(spark, d).map(lambda r: {"event_type": r.event_type, "c": _cents(r.value)}).group_until(True, lambda r: r.event_type != "purchase")
    return groups.map(lambda r: {"group": r.group, "n": F.size(r["items"]).cast("long"), "total": F.aggregate(r["items"], F.lit(0).cast("long"), lambda s, x: s + x.c)}).df


@_query("group_until_excl", f"select cast(g as bigint) as \"group\", count(*) filter (where event_type <> 'purchase') as n, coalesce(sum(c) filter (where event_type <> 'purchase'), 0)::bigint as total from ({_GROUPS}) group by g")
def group_until_excl(spark: SparkSession, d: str) -> DataFrame:
    groups = _events(spark, d).map(lambda r: {"event_type": r.event_type, "c": _cents(r.value)}).group_until(False, lambda r: r.event_type != "purchase", small=0)
    return groups.map(lambda r: {"group": r.group, "n": F.size(r["items"]).cast("long"), "total": F.aggregate(r["items"], F.lit(0).cast("long"), lambda s, x: s + x.c)}).df


@_query("fold_until", f"select cast(g as bigint) as \"group\", count(*) filter (where event_type <> 'purchase') as size, max(c) filter (where event_type <> 'purchase') as most from ({_GROUPS}) group by g")
def fold_until(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"event_type": r.event_type, "c": _cents(r.value)}).fold_until(False, lambda r: r.event_type != "purchase", most=lambda r: F.max(r.c)).df


_SCAN = "select -1::bigint as o_orderkey, 0::bigint as value union all select o_orderkey, sum({c}) over (order by o_orderkey rows unbounded preceding)::bigint from orders".format(c=_CENTS.format("o_totalprice"))


def _scanned(spark: SparkSession, d: str, small: int | None) -> DataFrame:
    flow = _orders(spark, d).scan("sum", lambda r: _cents(r.o_totalprice), 0, keep=lambda r: {"o_orderkey": r.o_orderkey}, small=small)
    return flow.map(lambda r: {"o_orderkey": F.coalesce(r.o_orderkey, F.lit(-1)), "value": r.value}).df


@_query("scan_running", _SCAN)
def scan_running(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, None)


@_query("scan_two_phase", _SCAN)
def scan_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """The plan of large inputs."""
    return _scanned(spark, d, 0)


@_query("scan_fold", """
with recursive p as (select p_partkey k, row_number() over (order by p_partkey) i from part),
s as (select cast(0 as bigint) i, cast(1 as bigint) as value union all select p.i, (s.value * 31 + p.k) % 1000003 from s join p on p.i = s.i + 1)
select i, value from s""")  # fmt: skip
def scan_fold(spark: SparkSession, d: str) -> DataFrame:
    part = _table("part", "p_partkey")(spark, d).map(lambda r: {"k": r.p_partkey})
    return part.scan_fold(lambda s, x: (s * 31 + x.k) % 1000003, F.lit(1).cast("long")).mapi(lambda i, r: {"i": i, "value": r.value}).df


@_query("scan_python", _SQL["scan_fold"])
def scan_python(spark: SparkSession, d: str) -> DataFrame:
    part = _table("part", "p_partkey")(spark, d).map(lambda r: {"k": r.p_partkey})
    return part.scan_py(lambda s, k: (s * 31 + k) % 1000003, 1, "long").mapi(lambda i, r: {"i": i, "value": r.value}).df


# searches


@_query("try_find", "select event_id, event_type, value from events where value > 90 order by event_id limit 1")
def try_find(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"event_id": r.event_id, "event_type": r.event_type, "value": r.value}).try_find_df(lambda r: r.value > 90)


@_query("try_pick", "select event_id * 10 as value from events where event_type = 'purchase' order by event_id limit 1")
def try_pick(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).try_pick_df(lambda r: F.when(r.event_type == "purchase", r.event_id * 10))


@_query("head", "select event_id, user_id from events order by event_id limit 1")
def head(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"event_id": r.event_id, "user_id": r.user_id}).try_head_df()


@_query("first_or_default", "select coalesce((select event_id from events where value < -1e9 order by event_id limit 1), -1) event_id")
def first_or_default(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter(lambda r: r.value < -1e9).map(lambda r: {"event_id": r.event_id}).first_or_default_df({"event_id": -1})


@_query("exists", "select coalesce(bool_or(o_totalprice > 400000), false) as value from orders")
def exists(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).exists_df(lambda r: r.o_totalprice > 400000)


@_query("forall", "select coalesce(bool_and(o_totalprice > 0), true) as value from orders")
def forall(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).forall_df(lambda r: r.o_totalprice > 0)


@_query("is_empty", "select count(*) = 0 as value from orders where o_orderkey < 0")
def is_empty(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(lambda r: r.o_orderkey < 0).is_empty_df()


# sources, caching, parallelism


@_query("init_infinite_take", "select i * 2 as value from range(1000) t(i)")
def init_infinite_take(spark: SparkSession, d: str) -> DataFrame:
    return S.init_infinite(spark, lambda i: i * 2).take(1000).df


@_query("init_infinite_filter", "select i * i as value from range(40000) t(i) where i * i % 7 = 2 order by i limit 5000")
def init_infinite_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.init_infinite(spark, lambda i: i * i).filter(lambda r: r.value % 7 == 2).take(5000).df


@_query("generate_infinite_take", "select 7 as value from range(100)")
def generate_infinite_take(spark: SparkSession, d: str) -> DataFrame:
    return S.generate_infinite(spark, lambda: F.lit(7)).take(100).df


@_query("generate_infinite_state", "select i as place, cast(1 + i * (i + 1) / 2 as bigint) as value from range(3000) t(i)")
def generate_infinite_state(spark: SparkSession, d: str) -> DataFrame:
    """Of a Python function with a state: 1, 2, 4, 7, ..."""

    def make():  # noqa: ANN202
        state = [0, 1]

        def f() -> int:
            out = state[1]
            state[0], state[1] = state[0] + 1, state[1] + state[0] + 1
            return out

        return f

    return S.generate_infinite_py(spark, make, "value long").take(3000).mapi(lambda i, r: {"place": i, "value": r.value}).df


@_query("zip_infinite", "select i * i + 3 * j as value from (select i, row_number() over (order by i) - 1 j from range(5000) t(i) where i % 5 = 2) where j < 900")
def zip_infinite(spark: SparkSession, d: str) -> DataFrame:
    """Of two endless flows, one of them filtered."""
    fifths = S.init_infinite(spark, lambda i: i).filter(lambda r: r.value % 5 == 2).map(lambda r: r.value * r.value)
    return fifths.zip_with(S.init_infinite(spark, lambda i: i * 3), lambda a, b: a.value + b.value).take(900).df


@_query("scan_infinite", "select cast(i * (i + 1) / 2 as bigint) as value from range(2000) t(i)")
def scan_infinite(spark: SparkSession, d: str) -> DataFrame:
    return S.init_infinite(spark, lambda i: i + 1).scan("sum", lambda r: r.value, F.lit(0).cast("long")).take(2000).df


@_query("of_text_lines", "select cast(row_number() over (order by o_orderkey) - 1 as bigint) line, 'This is file entry #' || o_orderkey as value from orders")
def of_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written and read again, with their numbers."""
    path = f"{shared_folder(spark)}/corrente-lines-{uuid.uuid4().hex}"
    _orders(spark, d).map(lambda r: F.concat(F.lit("This is file entry #"), r.o_orderkey.cast("string"))).write_text_lines(path)
    return S.of_text_file_by_line(spark, path).mapi(lambda i, r: {"line": i, "value": r.value}).df


@_query("with_dop", "select o_orderkey, o_custkey + 1 next_cust from orders where o_orderkey % 3 = 0")
def with_dop(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).with_degree_of_parallelism(3).filter(lambda r: r.o_orderkey % 3 == 0).map(lambda r: {"o_orderkey": r.o_orderkey, "next_cust": r.o_custkey + 1}).df


@_query("cached", "select o_orderkey from orders order by o_orderkey limit 10")
def cached(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_orderkey": r.o_orderkey}).cache().take(10).df


@_query("unordered", "select count(*) n, sum(o_orderkey)::bigint total from orders")
def unordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).unordered().fold_df(n=lambda r: F.count("*"), total=lambda r: F.sum(r.o_orderkey))


# sources of rows in memory, and sinks read back; nation and region have as many rows at any scale


@_query("empty", "select n_nationkey as k from nation where false")
def empty(spark: SparkSession, d: str) -> DataFrame:
    return S.empty(spark, "k int").df


@_query("singleton", "select 42 as value")
def singleton(spark: SparkSession, d: str) -> DataFrame:
    return S.singleton(spark, 42, "int").df


_NUMBERS = [3, -1, None, 4, 1, -5, 9]
_NUMBERS_SQL = "select cast(row_number() over () - 1 as bigint) as place, value from (values (3), (-1), (null), (4), (1), (-5), (9)) t(value)"
_numbered = lambda flow: flow.mapi(lambda i, r: {"place": i, "value": r.value}).df


@_query("of_array", _NUMBERS_SQL)
def of_array(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(S.of_rows(spark, tuple(_NUMBERS), "int"))


@_query("of_list", _NUMBERS_SQL)
def of_list(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(S.of_rows(spark, list(_NUMBERS), "int"))


@_query("of_resize_array", _NUMBERS_SQL)
def of_resize_array(spark: SparkSession, d: str) -> DataFrame:
    """A list that grew."""
    rows: list[int | None] = []
    for x in _NUMBERS:
        rows.append(x)
    return _numbered(S.of_rows(spark, rows, "int"))


@_query("of_seq", _NUMBERS_SQL)
def of_seq(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(S.of_seq(spark, (x for x in _NUMBERS), "int"))


@_query("of_list_unordered", "select sum(value)::bigint as total, count(*) n from (values (3), (-1), (null), (4), (1), (-5), (9)) t(value)")
def of_list_unordered(spark: SparkSession, d: str) -> DataFrame:
    return S.of_rows(spark, list(_NUMBERS), "int").unordered().fold_df(total=lambda r: F.sum(r.value), n=lambda r: F.count("*"))


@_query("of_resize_array_unordered", "select value as key, count(*) as count from (values (3), (3), (1)) t(value) group by all")
def of_resize_array_unordered(spark: SparkSession, d: str) -> DataFrame:
    return S.of_rows(spark, [3, 3, 1], "int").unordered().count_by(lambda r: r.value).df


@_query("of_stream_lines", "select cast(row_number() over () - 1 as bigint) as place, value from (values ('one'), (''), ('three'), ('four')) t(value)")
def of_stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """All three ends of lines."""
    return _numbered(S.of_stream_by_line(spark, io.BytesIO(b"one\n\rthree\r\nfour\n")))


@_query("as_flow", "select cast(row_number() over (order by n_nationkey) - 1 as bigint) as place, n_name as value from nation")
def as_flow(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_table("nation", "n_nationkey")(spark, d).unordered().as_flow("n_nationkey").map(lambda r: {"value": r.n_name}))


@_query("as_parallel_flow", "select count(*) as value from nation")
def as_parallel_flow(spark: SparkSession, d: str) -> DataFrame:
    return _table("nation", "n_nationkey")(spark, d).as_parallel_flow().length_df()


@_query("read_whole_text", "select string_agg('This is file entry #' || n_nationkey || chr(10), '' order by n_nationkey) as value from nation")
def read_whole_text(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/corrente-text-{uuid.uuid4().hex}"
    lines = _table("nation", "n_nationkey")(spark, d).map(lambda r: F.concat(F.lit("This is file entry #"), r.n_nationkey.cast("string")))
    lines.with_degree_of_parallelism(1).write_text_lines(path)
    return S.read_all_text(spark, path).df


_NATIONS = "select n_nationkey, n_name from nation"
_nations = lambda spark, d: _table("nation", "n_nationkey")(spark, d).map(lambda r: {"n_nationkey": r.n_nationkey, "n_name": r.n_name})
_again = lambda spark, rows: S.of_rows(spark, [tuple(r) for r in rows], "n_nationkey int, n_name string").df


@_query("to_array", _NATIONS)
def to_array(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).to_array())


@_query("to_resize_array", _NATIONS)
def to_resize_array(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).to_resize_array())


@_query("to_list", _NATIONS)
def to_list(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).to_list())


@_query("to_seq", _NATIONS)
def to_seq(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).to_seq())


@_query("to_enumerable", _NATIONS)
def to_enumerable(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).to_enumerable())


@_query("to_array_unordered", _NATIONS)
def to_array_unordered(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).unordered().to_array())


@_query("to_seq_unordered", _NATIONS)
def to_seq_unordered(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, _nations(spark, d).unordered().to_seq())


@_query("iter", _NATIONS)
def iterate(spark: SparkSession, d: str) -> DataFrame:
    seen: list = []
    _nations(spark, d).iter(seen.append)
    return _again(spark, seen)


@_query("iter_unordered", "select count(*) n, sum(n_nationkey)::bigint total from nation")
def iter_unordered(spark: SparkSession, d: str) -> DataFrame:
    """On the executors, which count as accumulators do."""
    sc = spark.sparkContext
    n, total = sc.accumulator(0), sc.accumulator(0)

    def see(r) -> None:  # noqa: ANN001
        n.add(1)
        total.add(r.n_nationkey)

    _nations(spark, d).unordered().iter(see)
    return S.of_rows(spark, [(n.value, total.value)], "n long, total long").df


@_query("to_string", "select 'Flow(n_nationkey, n_name; ordered by 1 keys)' as value union all select 'Flow(n_nationkey, n_name; unordered)'")
def to_string(spark: SparkSession, d: str) -> DataFrame:
    flow = _nations(spark, d)
    return S.of_rows(spark, [str(flow), str(flow.unordered())], "string").df


@_query("find", "select event_id, event_type from events where event_type = 'purchase' order by event_id limit 1")
def find(spark: SparkSession, d: str) -> DataFrame:
    found = _events(spark, d).map(lambda r: {"event_id": r.event_id, "event_type": r.event_type}).find(lambda r: r.event_type == "purchase")
    return S.singleton(spark, tuple(found), "event_id long, event_type string").df


@_query("pick", "select event_id * 10 as value from events where event_type = 'purchase' order by event_id limit 1")
def pick(spark: SparkSession, d: str) -> DataFrame:
    return S.singleton(spark, _events(spark, d).pick(lambda r: F.when(r.event_type == "purchase", r.event_id * 10))[0], "long").df


@_query("first", "select o_orderkey as value from orders order by o_orderkey limit 1")
def first(spark: SparkSession, d: str) -> DataFrame:
    return S.singleton(spark, _orders(spark, d).first().o_orderkey, "long").df


@_query("first_where", "select o_orderkey as value from orders where o_totalprice > 200000 order by o_orderkey limit 1")
def first_where(spark: SparkSession, d: str) -> DataFrame:
    return S.singleton(spark, _orders(spark, d).first(lambda r: r.o_totalprice > 200000).o_orderkey, "long").df


@_query("ordered", "select o_orderkey, cast(row_number() over (order by o_custkey, o_orderkey) - 1 as bigint) as rank from orders")
def ordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).unordered().ordered("o_custkey", "o_orderkey").mapi(_rank).df


def _every_third(flow: Flow) -> Flow:
    return flow.mapi(lambda i, r: {"i": i, "o_orderkey": r.o_orderkey}).filter(lambda r: r.i % 3 == 0).map(lambda r: {"o_orderkey": r.o_orderkey})


@_query("own_operator", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 i from orders) where i % 3 = 0")
def own_operator(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).transform(_every_third).df


@_query("own_operator_unordered", "select distinct o_custkey from orders")
def own_operator_unordered(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map(lambda r: {"o_custkey": r.o_custkey}).unordered().with_frame(lambda df: df.distinct()).df


@_query("distinct_keys", "select distinct event_type as key from events")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).unordered().distinct_keys(lambda r: r.event_type)


# user functions


@_query("udf_scalar", f"select event_id, {_EVENT_CENTS} * 3 + 1 as value from events")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    triple = custom.scalar(lambda x: x * 3 + 1, "long")
    return _events(spark, d).map(lambda r: {"event_id": r.event_id, "value": triple(_cents(r.value))}).df


@_query("map_python", f"select event_id, {_EVENT_CENTS} % 10 as digit from events")
def map_python(spark: SparkSession, d: str) -> DataFrame:
    cents = _events(spark, d).map(lambda r: {"event_id": r.event_id, "c": _cents(r.value)})
    return cents.map_py(lambda x: pd.DataFrame({"event_id": x["event_id"], "digit": x["c"].abs() % 10 * x["c"].map(lambda v: -1 if v < 0 else 1)}), "event_id long, digit long").df


@_query("udtf_expand", "select p_partkey, unnest(range(1, p_size + 1)) as i from part")
def udtf_expand(spark: SparkSession, d: str) -> DataFrame:
    class Numbers:
        def eval(self, n: int):  # noqa: ANN202
            for i in range(1, n + 1):
                yield (i,)

    part = _table("part")(spark, d).map(lambda r: {"p_partkey": r.p_partkey, "n": r.p_size})
    return part.lateral_udtf(custom.table(Numbers, "i bigint"), lambda r: r.n).map(lambda r: {"p_partkey": r.p_partkey, "i": r.i}).df


@_query("flatmap_python", "select p_partkey * 100 + unnest(range(0, p_size)) as value from part")
def flatmap_python(spark: SparkSession, d: str) -> DataFrame:
    return _table("part", "p_partkey")(spark, d).flat_map_py(lambda k, n: (k * 100 + i for i in range(n)), "value long", "p_partkey", "p_size").df


@_query("udaf_fold", f"select event_type as key, max({_EVENT_CENTS}) - min({_EVENT_CENTS}) as value from events group by all")
def udaf_fold(spark: SparkSession, d: str) -> DataFrame:
    spread = custom.grouped(lambda x: int(x.max() - x.min()), "long")
    return _events(spark, d).unordered().map(lambda r: {"event_type": r.event_type, "c": _cents(r.value)}).fold_by(lambda r: r.event_type, value=lambda r: spread(r.c)).df


@_query("fold_by_python", _SQL["fold_by_ordered"])
def fold_by_python(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(lambda r: {"user_id": r.user_id, "c": _cents(r.value)}).fold_by_py(lambda r: r.user_id, lambda s, x: (s * 31 + int(x[1])) % 1000003, lambda: 7, "long").df


# the published micro-benchmarks

N_BENCH = 10_000_000


@_query("bench_simple", f"select sum(i + 1)::bigint as value from range(1, {N_BENCH + 1}) t(i) where i % 2 = 0")
def bench_simple(spark: SparkSession, d: str) -> DataFrame:
    return Flow.over(spark.range(1, N_BENCH + 1)).filter(lambda r: r.id % 2 == 0).map(lambda r: r.id + 1).sum_df()


@_query("bench_complex", f"select sum(v % 17)::bigint as value from (select i + 1 v from range(1, {N_BENCH + 1}) t(i) where i % 2 = 0 order by v limit 100)")
def bench_complex(spark: SparkSession, d: str) -> DataFrame:
    return Flow.over(spark.range(1, N_BENCH + 1)).filter(lambda r: r.id % 2 == 0).map(lambda r: r.id + 1).sort_by(lambda r: r.value).take(100).map(lambda r: r.value % 17).sum_df()
