"""Flows against a plain-Python model, over random lists."""

import functools
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrente import sources as S

some = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
ints = st.lists(st.integers(-50, 50), max_size=12)
nullable = st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=12)


def flow(spark, xs):
    return S.of_rows(spark, xs, "long")


@some
@given(ints)
def test_projection(spark, xs):
    f = flow(spark, xs)
    assert f.map(lambda r: r.value * 2).values() == [x * 2 for x in xs]
    assert f.filter(lambda r: r.value % 2 == 0).mapi(lambda i, r: r.value + i).values() == [x + i for i, x in enumerate(x for x in xs if x % 2 == 0)]
    assert f.mapi(lambda i, r: r.value * 100 + i, small=0).values() == [x * 100 + i for i, x in enumerate(xs)]
    assert f.choose(lambda r: F.when(r.value > 0, r.value + 1)).values() == [x + 1 for x in xs if x > 0]
    expanded = [i for x in xs for i in range(1, x + 1)]
    assert f.flat_map(lambda r: F.when(r.value >= 1, F.sequence(F.lit(1), r.value))).values() == expanded
    assert f.flat_map_py(lambda x: range(1, x + 1), "value long").values() == expanded


@some
@given(ints, st.integers(0, 15), st.integers(-3, 15))
def test_limits(spark, xs, n, k):
    f = flow(spark, xs)
    assert f.take(n).values() == xs[:n]
    assert f.skip(k).values() == xs[max(k, 0) :]
    assert f.skip(k).take(n).values() == xs[max(k, 0) :][:n]
    assert f.take(n).skip(k).values() == xs[:n][max(k, 0) :]
    assert f.skip(1).skip(k).map(lambda r: r.value).values() == xs[1:][max(k, 0) :]
    assert f.take_while(lambda r: r.value < 10).values() == list(itertools.takewhile(lambda x: x < 10, xs))
    assert f.unordered().take(n).length() == len(xs[:n])
    assert f.unordered().skip(k).length() == len(xs[max(k, 0) :])


@some
@given(ints)
def test_sorts(spark, xs):
    f = flow(spark, xs)
    key = lambda x: x % 5
    own = lambda r: (r.value % 5 + 5) % 5
    assert f.sort_by(own).values() == sorted(xs, key=key)
    assert f.sort_by_descending(own).values() == sorted(xs, key=key, reverse=False) if not xs else True
    assert f.sort_by_descending(own).values() == sorted(xs, key=lambda x: -key(x))
    by = lambda a, b: F.signum((b - a).cast("double")).cast("int")
    assert f.sort_by_using(lambda r: r.value, by).values() == sorted(xs, reverse=True)
    assert f.sort_by_using(lambda r: r.value, keys=lambda k: [F.abs(k), k]).values() == sorted(xs, key=lambda x: (abs(x), x))
    assert f.sort_by_descending(lambda r: r.value).take_while(lambda r: r.value > 0).values() == [x for x in sorted(xs, reverse=True) if x > 0]


@some
@given(ints, ints)
def test_several_inputs(spark, xs, ys):
    a, b = flow(spark, xs), flow(spark, ys)
    assert a.zip_with(b, lambda x, y: x.value * 1000 + y.value).values() == [x * 1000 + y for x, y in zip(xs, ys, strict=False)]
    assert a.concat(b, a).values() == xs + ys + xs
    assert a.concat(b.sort_by(lambda r: r.value)).values() == xs + sorted(ys)
    assert a.flat_map_flow(b, lambda x, y: x.value * 1000 + y.value).values() == [x * 1000 + y for x in xs for y in ys]
    assert a.flat_map_flow(b, lambda x, y: y.value, on=lambda x, y: x.value == y.value).values() == [y for x in xs for y in ys if x == y]
    assert a.exists_in(b, lambda x, y: x.value == y.value).values() == [x for x in xs if x in ys]
    assert a.exists_in(b, lambda x, y: x.value == y.value, negate=True).values() == [x for x in xs if x not in ys]
    assert sorted(S.of_seqs(spark, [xs, ys], "long").values()) == sorted(xs + ys)


@some
@given(ints)
def test_folds(spark, xs):
    f = flow(spark, xs)
    assert f.sum() == sum(xs)
    assert f.length() == len(xs)
    poly = lambda s, x: s * 3 - x
    assert f.fold_ordered(lambda s, e: s * 3 - e.value, F.lit(1).cast("long")) == functools.reduce(poly, xs, 1)
    assert f.fold_py(poly, 1) == functools.reduce(poly, xs, 1)
    states = list(itertools.accumulate(xs, poly, initial=1))
    assert f.scan_fold(lambda s, e: s * 3 - e.value, F.lit(1).cast("long")).values() == states
    assert f.scan_py(poly, 1, "long").values() == states
    for small in (None, 0):
        assert f.scan("sum", lambda r: r.value, 5, small=small).values() == list(itertools.accumulate(xs, initial=5))
        assert f.scan("max", lambda r: r.value, 0, small=small).values() == list(itertools.accumulate(xs, max, initial=0))
    if xs:
        assert f.max_by(lambda r: r.value)[0] == max(xs)
        assert f.mapi(lambda i, r: {"i": i, "k": (r.value % 3 + 3) % 3}).min_by(lambda r: r.k)["i"] == min(range(len(xs)), key=lambda i: xs[i] % 3)
        assert f.mapi(lambda i, r: {"i": i, "k": (r.value % 3 + 3) % 3}).max_by(lambda r: r.k)["i"] == max(range(len(xs)), key=lambda i: (xs[i] % 3, -i))


@some
@given(nullable)
def test_folds_by_key(spark, xs):
    f = flow(spark, xs)
    keys = list(dict.fromkeys(xs))
    assert [tuple(r) for r in f.count_by(lambda r: r.value).to_list()] == [(k, xs.count(k)) for k in keys]
    groups = f.mapi(lambda i, r: {"k": r.value, "i": i}).group_by(lambda r: r.k)
    assert [(r.key, [x.i for x in r["items"]]) for r in groups.to_list()] == [(k, [i for i, x in enumerate(xs) if x == k]) for k in keys]
    down = f.mapi(lambda i, r: {"k": r.value, "i": i}).sort_by_descending(lambda r: r.i).group_by(lambda r: r.k)
    assert [(r.key, [x.i for x in r["items"]]) for r in down.to_list()] == [(k, [i for i, x in reversed(list(enumerate(xs))) if x == k]) for k in dict.fromkeys(reversed(xs))]
    places = f.mapi(lambda i, r: {"k": r.value, "i": i})
    expect = {k: functools.reduce(lambda s, i: s * 7 + i, [i for i, x in enumerate(xs) if x == k], 1) for k in keys}
    assert {r.key: r.value for r in places.fold_by_ordered(lambda r: r.k, lambda s, e: s * 7 + e.i, F.lit(1).cast("long")).to_list()} == expect
    assert {r.key: r.value for r in places.fold_by_py(lambda r: r.k, lambda s, e: s * 7 + int(e[1]), lambda: 1, "long").to_list()} == expect
    assert {r.key: r.n for r in f.fold_by(lambda r: r.value, n=lambda r: F.count("*")).to_list()} == {k: xs.count(k) for k in keys}


def until(xs, inclusive, p):
    out, group = [], []
    for x in xs:
        if p(x):
            group.append(x)
        else:
            out.append(group + [x] * inclusive)
            group = []
    return out + [group] * bool(group)


@some
@given(st.lists(st.sampled_from([1, 2, 3, 7, 7]), max_size=10))
def test_group_until(spark, xs):
    f = flow(spark, xs)
    for inclusive, small in ((True, None), (False, None), (True, 0), (False, 0)):
        expect = until(xs, inclusive, lambda x: x != 7)
        assert [[e.value for e in r["items"]] for r in f.group_until(inclusive, lambda r: r.value != 7, small=small).to_list()] == expect
        assert [(r.size, r.total) for r in f.fold_until(inclusive, lambda r: r.value != 7, small=small, total=lambda r: F.sum(r.value)).to_list()] == [(len(g), sum(g) if g else None) for g in expect]


@some
@given(nullable)
def test_searches(spark, xs):
    f = flow(spark, xs)
    big = [x for x in xs if x is not None and x > 2]
    found = f.try_find(lambda r: r.value > 2)
    assert (found.value if found else None) == (big[0] if big else None)
    picked = f.try_pick(lambda r: F.when(r.value > 2, r.value * 10))
    assert (picked.value if picked else None) == (big[0] * 10 if big else None)
    assert f.exists(lambda r: r.value > 2) == bool(big)
    assert f.exists_df(lambda r: r.value > 2).first()[0] == bool(big)
    assert f.forall(lambda r: r.value > 2) == (len(big) == len(xs))
    assert f.forall_df(lambda r: r.value > 2).first()[0] == (len(big) == len(xs))
    assert f.is_empty() == f.is_empty_df().first()[0] == (not xs)
    head = f.try_head()
    assert (head is None) == (not xs) and (not xs or head.value == xs[0])
    assert f.first_or_default_df({"value": 99}).first()[0] == (xs[0] if xs else 99)


@pytest.mark.parametrize("xs", [[1, 7, 7, 2, 3], [1, 7], [7], []])
def test_group_until_edges(spark, xs):
    f = flow(spark, xs)
    assert [[e.value for e in r["items"]] for r in f.group_until(False, lambda r: r.value != 7).to_list()] == until(xs, False, lambda x: x != 7)
