import zlib
from collections import Counter, defaultdict

import pytest

from corrente.llm import sharding


def test_report(docs, texts):
    out = sharding.shard_report(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = sharding.shard_report(docs.repartition(6)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(out, key=key) == sorted(again, key=key)


def test_one_text_only_is_spread(spark):
    out = sharding.shard_rows(spark.range(1000).selectExpr("id doc_id", "'same' text", "1 shard", "2 slot"), 7)
    assert out.columns == ["doc_id", "text", "shard", "slot", "_shard", "_slot"]
    assert {(r.shard, r.slot) for r in out.collect()} == {(1, 2)}  # own columns stay
    assert sorted(r[1] for r in out.groupBy("_shard").count().collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_few_rows_move_to_a_new_shard():
    counts = {c: 10 for c in range(0, sharding.CELLS, 4)}

    def of(n):
        where = defaultdict(dict)
        for cell, lo, hi, shard, _ in sharding.segments(counts, n):
            for i in range(lo, hi):
                where[cell][i] = shard
        return where

    a, b = of(40), of(41)
    moved = sum(a[c][i] != b[c][i] for c in counts for i in range(10))
    assert moved < 0.06 * sum(counts.values())  # 1 / 41 at best


def test_segments_cover_every_row_once():
    counts = {5: 1000, 6: 1, 16000: 30}
    seen = Counter()
    for cell, lo, hi, _, _ in sharding.segments(counts, 9):
        seen.update((cell, i) for i in range(lo, hi))
    assert seen == Counter((c, i) for c, n in counts.items() for i in range(n))


def test_empty_and_wrong(none):
    assert sharding.shard_report(none).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(none, 0)


def test_rows_walk_the_ring(spark):
    """Row by row: each tries the nodes clockwise from its cell, all in step, and stays at the first whose shard has room."""
    import hashlib

    n, vnodes, cells = 7, 64, sharding.CELLS
    frame = spark.createDataFrame([(i % 400, f"text {i % 90}") for i in range(1500)] + [(None, None)] * 3, "doc_id long, text string")
    got = sharding.shard_rows(frame, n).selectExpr("*", f"cast(pmod(xxhash64('ring', doc_id, text), {cells}) as int) cell", "xxhash64('ring', doc_id, text) h").collect()
    point = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big")
    ring = sorted((point(s, v) % cells, point(s, v), s) for s in range(n) for v in range(vnodes))
    shard_at = [s for _, _, s in ring]
    total = len(got)
    turn = sorted(range(n), key=lambda s: hashlib.sha256(f"room {s}".encode()).digest())
    room = {s: total // n + (turn.index(s) < total % n) for s in range(n)}
    rows = sorted((r.cell, r.h, r.doc_id is not None, r.doc_id or 0) for r in got)
    place = {}
    waiting = [(next((k for k, (c, _, _) in enumerate(ring) if c >= row[0]), 0), i) for i, row in enumerate(rows)]
    while waiting:
        on = []
        for node, i in sorted(waiting):
            if room[shard_at[node]]:
                room[shard_at[node]] -= 1
                place[i] = shard_at[node]
            else:
                on.append((node, i))
        waiting = []
        for node, i in on:
            node = (node + 1) % len(ring)
            while not room[shard_at[node]]:
                node = (node + 1) % len(ring)
            waiting.append((node, i))
    want = Counter((rows[i][2:], s) for i, s in place.items())
    assert Counter(((r.doc_id is not None, r.doc_id or 0), r.shard) for r in got) == want
