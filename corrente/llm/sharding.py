"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  Every shard owns ``vnodes`` of them; a
row hashes to a cell and belongs to the next virtual node clockwise.  A shard
takes rows up to its capacity; what overflows continues clockwise to the next
virtual node whose shard has room.  Capacities add up to the number of rows and
differ by one at most, so the law is ``rows``: counts at most one apart, however
the data are skewed, while a row moves only if its shard was full.

Only counts per cell (a table of at most ``CELLS`` rows, whatever the input)
reach the driver.  A hot text does not matter: id and text together choose the
cell, so copies spread over the ring.

Defined results.  Nulls: a null text hashes and weighs as none; a null id hashes
as null.  Ties: equal rows share a cell, and any of them may take any of their
slots.  A very long text is one row like any other.  Clashing names: own columns
stay, an added column of the same name gets an underscore before its name.  An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised, named, order_hash, own_columns, packed_rows, unused

CELLS = 1 << 14
VNODES = 64


def ring(n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big")
    return [(c, s) for c, _, s in sorted((h % cells, h, s) for s in range(n_shards) for v in range(vnodes) for h in [at(s, v)])]


def segments(counts: dict[int, int], n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each cell go: (cell, first rank, rank after the last, shard, slot of the first)."""
    nodes, total = ring(n_shards, vnodes, cells), sum(counts.values())
    where = [c for c, _ in nodes]
    turn = sorted(range(n_shards), key=lambda s: hashlib.sha256(f"room {s}".encode()).digest())
    room = {s: total // n_shards + (k < total % n_shards) for k, s in enumerate(turn)}
    used = dict.fromkeys(room, 0)
    at, out = {}, []
    for cell, n in counts.items():
        at.setdefault(bisect.bisect_left(where, cell) % len(nodes), []).append((cell, 0, n))
    while at:
        on = {}
        for node in sorted(at):
            shard = nodes[node][1]
            for cell, lo, hi in sorted(at[node]):
                k = min(hi - lo, room[shard])
                if k:
                    out.append((cell, lo, lo + k, shard, used[shard]))
                    room[shard] -= k
                    used[shard] += k
                if lo + k < hi:
                    on.setdefault(node, []).append((cell, lo + k, hi))
        at = {}
        for node, left in on.items():
            to = (node + 1) % len(nodes)
            while not room[nodes[to][1]]:
                to = (to + 1) % len(nodes)
            at.setdefault(to, []).extend(left)
    return out


def shard_rows(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard) to every row."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    placed = packed_rows(docs, id=id_col, h=order_hash(named(id_col), named(text_col), seed="ring")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("cell").agg(F.count("*")).collect()}
    parts = segments(counts, n_shards, vnodes)
    # at most CELLS + n_shards x vnodes rows, unpacked from one literal
    text = F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";")
    parts = docs.sparkSession.range(1).select(F.explode(text).alias("p")).where("p <> ''").select(F.split("p", ",").alias("p"))
    parts = parts.select(*[F.get("p", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate((("cell", "int"), ("lo", "long"), ("hi", "long"), ("shard", "int"), ("base", "long")))])
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id")).cast("long") - 1)
    joined = ranked.join(F.broadcast(parts), "cell").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select(*own_columns(docs), F.col("shard").alias(unused(docs, "shard")), (F.col("base") + F.col("rank") - F.col("lo")).alias(unused(docs, "slot")))


def shard_report(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        # stands for the text on the ring, so that the text itself is not shuffled
        F.xxhash64("text").alias("text"),
    )
    out = shard_rows(materialised(slim), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
