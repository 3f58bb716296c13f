"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more component that makes all lengths equal, so that a larger
inner product is a smaller distance.  Every distinct vector is keyed by its
nearest pivot and its distance from it; the distances of a pivot are cut into
annuli.  A query visits the annuli in the order of their lower bounds, which the
triangle inequality gives: first the nearest few, whose k-th best score sets a
radius, then all others that the radius reaches.  The bounds only skip annuli
that cannot hold a result, so the answer is exact.

Equal vectors are one entry with its k + 1 smallest ids (repeated ones as often
as they occur), as no more of them can be among the k best of a query; a vector
that a third of all rows share costs as much as any other.  Annuli of many
vectors are split into blocks, and the queries of a block into groups, so that
no task holds more than about ``BLOCK`` vectors and ``QUERIES`` queries.

In many dimensions few annuli can be left out, so the work nears queries x rows;
``top_k`` counts what it visited, if asked.

Defined results.  Nulls: vectors that are null or hold null, NaN or infinite
components take no part; a null id is no query, but its row is a candidate, and
comes after all ids where scores tie.  Repeated rows: every row counts by
itself; a query leaves out its own row only, not others of its id or vector, and
a query row that occurs twice is answered twice.  Vectors are compared with
those of their own length only.  Ties go to the smaller id.  Very long vectors
are compared whole.  Clashing names: only the id and the vector are read, other
columns are ignored.  A query with fewer candidates returns them all.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, materialised, named, order_hash

BLOCK, QUERIES, MAX_PIVOTS, PIVOT_SAMPLE = 2048, 4096, 256, 4096
_SLACK = 1e-6
_PAIRS_A_BATCH = 20_000


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, null if the vector takes no part."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each list of ``width`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows: in doubles where these hold every sum exactly."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Pivots:
    """Pivots for vectors of one length, and the squared length that all are raised to."""

    def __init__(self, points: np.ndarray, longest: float, count: int):
        self.longest = longest
        p = points.astype(float)
        p = np.column_stack((p, np.sqrt(np.maximum(longest - (p * p).sum(1), 0.0))))
        # farthest-first traversal
        chosen, far = [0], np.full(len(p), np.inf)
        while len(chosen) < min(count, len(p)):
            far = np.minimum(far, ((p - p[chosen[-1]]) ** 2).sum(1))
            nxt = int(far.argmax())
            if far[nxt] <= 0:
                break
            chosen.append(nxt)
        self.p = p[chosen]

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        x = v.astype(float)
        sq = (x * x).sum(1)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - sq, 0.0))
        d2 = (sq + last * last)[:, None] + (self.p * self.p).sum(1)[None, :] - 2 * (np.column_stack((x, last)) @ self.p.T)
        return np.sqrt(np.maximum(d2, 0.0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", stats: dict[str, int] | None = None) -> DataFrame:
    """query_id, rank (from 1), the id and the score (inner product of the quantised vectors) of the k best of every query.  stats: gets how many pairs of a query and a block there are, and how many were visited."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    rows = vectors.select(named(id_col).cast("long").alias("id"), quantised(named(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("v").isNotNull())
    rows = materialised(rows)
    by_vector = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    first = rows.withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), lambda x: x["id"])
    asked = rows.where(F.col("q") & F.col("id").isNotNull())
    distinct = first.groupBy("v").agg(ids.alias("ids")).join(asked.groupBy("v").agg(F.lit(True).alias("q")), "v", "left")
    distinct = materialised(distinct.select("v", "ids", F.coalesce("q", F.lit(False)).alias("q"), F.size("v").alias("dim"), F.monotonically_increasing_id().alias("key")))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    dims = distinct.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()
    index: dict[int, Pivots] = {}
    for dim, n, longest in dims:
        sample = distinct.where(F.col("dim") == dim).select("v").orderBy(order_hash("v", seed="pivot"), "v").limit(PIVOT_SAMPLE).collect()
        index[dim] = Pivots(np.array([r[0] for r in sample], np.int64).reshape(len(sample), dim), float(longest), max(1, min(MAX_PIVOTS, n // BLOCK)))
    sent = spark.sparkContext.broadcast(index)  # at most MAX_PIVOTS vectors a length

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(1).to_numpy()
            pivot, dist = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = sent.value[int(d)].distances(_matrix(batch.column(0).take(pa.array(at)), int(d)), False)
                pivot[at], dist[at] = x.argmin(1), x.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(dist)], names=["v", "dim", "ids", "key", "pivot", "dist"])

    keyed = materialised(distinct.select("v", "dim", "ids", "key").mapInArrow(near_pivot, "v array<long>, dim int, ids array<long>, key long, pivot int, dist double"))
    pivots = keyed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    rings = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.col("n") / BLOCK))).cast("int")
    pivots = materialised(pivots.withColumn("rings", rings))
    ring = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("dist") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("rings")), F.col("rings") - 1)).otherwise(0).cast("int")
    keyed = keyed.join(F.broadcast(pivots), ["dim", "pivot"]).withColumn("ring", ring).select("v", "ids", "key", "dim", "pivot", "ring", "dist")  # MAX_PIVOTS rows a length
    cells = keyed.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("dim", "pivot", "ring").collect()
    blocks: dict[int, list[tuple]] = {}
    for i, c in enumerate(cells):
        blocks.setdefault(c["dim"], []).append((i, c["pivot"], c["lo"], c["hi"], c["n"], -(-c["n"] // BLOCK)))
    cell_rows = spark.createDataFrame([(c["dim"], c["pivot"], c["ring"], i, -(-c["n"] // BLOCK)) for i, c in enumerate(cells)], "dim int, pivot int, ring int, cell int, parts int")
    placed = keyed.join(F.broadcast(cell_rows), ["dim", "pivot", "ring"])
    store = materialised(placed.select("cell", F.pmod(order_hash("v", seed="block"), F.col("parts")).cast("int").alias("part"), "key", "v", "ids"))
    queries = materialised(distinct.where("q").select("key", "v", "dim"))
    table = spark.sparkContext.broadcast(blocks)

    def reach(near: bool):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim = batch.column(2).to_numpy()
                bound = None if near else batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                for d in np.unique(dim):
                    at = np.flatnonzero(dim == d)
                    v = _matrix(batch.column(1).take(pa.array(at)), int(d))
                    pivots = sent.value[int(d)]
                    cell, pivot, lo, hi, n, parts = (np.array(x) for x in zip(*table.value[int(d)], strict=True))
                    dist = pivots.distances(v, True)[:, pivot]
                    least = np.maximum(np.maximum(lo[None, :] - dist, dist - hi[None, :]), 0.0)
                    order = np.argsort(least, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(least.shape, bool)
                    np.put_along_axis(first, order, before < BLOCK, axis=1)
                    if near:
                        use = first
                    else:
                        r2 = (v.astype(float) ** 2).sum(1) + pivots.longest - 2 * bound[at]
                        radius = np.where(np.isnan(r2), np.inf, np.sqrt(np.maximum(r2, 0.0)))
                        use = ~first & (least <= radius[:, None] * (1 + _SLACK) + _SLACK * (1 + np.sqrt(pivots.longest)))
                    i, j = np.nonzero(use)
                    times = parts[j]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    i, j = np.repeat(at[i], times), np.repeat(j, times)
                    for a in range(0, len(i), _PAIRS_A_BATCH):
                        b = slice(a, a + _PAIRS_A_BATCH)
                        take = pa.array(i[b])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[j[b]].astype(np.int32)), pa.array(part[b].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "part", "key", "v"])

        return work

    kind, answer = "cell int, part int, key long, v array<long>", pa.schema([("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return answer.empty_table()
        width = len(left["v"][0])
        score = inner(_matrix(right["v"], width), _matrix(left["v"], width))
        take = min(k + 1, score.shape[1])
        least = -np.partition(-score, take - 1, axis=1)[:, take - 1]
        ids, keys, out = left["ids"].to_pylist(), left["key"].to_numpy(), []
        for q, s, bar in zip(right["key"].to_pylist(), score, least, strict=True):
            best = sorted((-int(s[i]), x is None, x or 0, bool(keys[i] == q)) for i in np.flatnonzero(s >= bar) for x in ids[i])[: k + 1]
            out += [(q, None if none else x, -y, own) for y, none, x, own in best]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), answer, strict=True)], schema=answer)

    def visited(wanted: DataFrame) -> DataFrame:
        """The k + 1 best of each query in the blocks it visits."""
        wanted = materialised(wanted)
        if stats is not None:
            stats["visited"] = stats.get("visited", 0) + wanted.count()
        groups = materialised(wanted.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")))
        held = store.join(groups, ["cell", "part"]).select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "key", "v", "ids")
        again = groups.toDF("cell", "part", "of")
        asks = wanted.join(again, ["cell", "part"]).select("cell", "part", F.pmod(order_hash("key", seed="group"), F.col("of")).cast("int").alias("group"), "key", "v")
        on = ["cell", "part", "group"]
        return held.groupBy(*on).cogroup(asks.groupBy(*on)).applyInArrow(search, "key long, id long, score long, own boolean")

    if stats is not None:
        per_dim = {r[0]: r[1] for r in queries.groupBy("dim").agg(F.count("*")).collect()}
        stats["pairs"] = sum(per_dim.get(d, 0) * sum(c[-1] for c in cells_of) for d, cells_of in blocks.items())
    in_order = [F.desc("score"), F.col("id").asc_nulls_last()]
    best = Window.partitionBy("key").orderBy(*in_order)
    near = materialised(visited(queries.select("key", "v", "dim").mapInArrow(reach(True), kind)))
    # the score of the k+1-th best so far; none, if there are fewer
    bar = near.withColumn("at", F.row_number().over(best)).where(F.col("at") == k + 1).select("key", F.col("score").alias("bar"))
    far = visited(queries.join(bar, "key", "left").select("key", "v", "dim", "bar").mapInArrow(reach(False), kind))
    found = materialised(near.unionByName(far).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"))
    # each query leaves out one row of its own id and vector, and is answered as often as it occurs
    asking = asked.groupBy(F.col("id").alias("query_id"), "v").agg(F.count("*").alias("times")).join(queries.select("v", "key"), "v").drop("v")
    out = asking.join(found, "key").withColumn("mine", F.col("own") & F.col("id").eqNullSafe(F.col("query_id")))
    out = out.withColumn("at", F.row_number().over(Window.partitionBy("key", "query_id", "mine").orderBy("score"))).where(~(F.col("mine") & (F.col("at") == 1)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("key", "query_id").orderBy(*in_order))).where(F.col("rank") <= k)
    return out.withColumn("time", F.explode(F.expr("sequence(1L, times)"))).select("query_id", "rank", F.col("id").alias(id_col), "score")


def report(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the five best of every row whose id is divisible by 50."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
with e as (
  select row_number() over () row_no, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row_no, q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score
  from e q join e c on q.vec_id % 50 = 0 and q.row_no <> c.row_no and len(q.v) = len(c.v)
), r as (select *, cast(row_number() over (partition by row_no order by score desc, vec_id nulls last) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
