import re
from collections import defaultdict

import numpy as np

from corrente.llm import mixing


def brute_targets(sizes):
    """sizes by source: water-filling round after round."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_taken_words(docs, texts):
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(texts)
    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts]
    source = [[None, "web", "web", "web", "books"][k % 5] for k in range(len(texts))]
    sizes = defaultdict(int)
    for s, c in zip(source, counts, strict=True):
        sizes[s] += c
    target = brute_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size) for r in out) == sorted((i is None, i or 0, c, sizes[s]) for (i, _), c, s in zip(texts, counts, source, strict=True))
    by_size = {v: k for k, v in sizes.items()}
    taken = defaultdict(int)
    for r in out:
        s = by_size[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        # one text may be longer than all that its source should give
        largest = max(c for c, x in zip(counts, source, strict=True) if x == s)
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s] + 30, largest - target[s]), (s, taken[s], target[s])
    again = mixing.mix_report(docs.repartition(5)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(out, key=key) == sorted(again, key=key)


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(1)
    strata = [(s, int(x), int(n)) for s in ("sa", "sb") for x, n in zip(range(1, 40), rng.integers(1, 50, 39), strict=True)]
    frame = spark.createDataFrame(strata, "skey string, size long, n long")
    sums = {s: sum(x * n for k, x, n in strata if k == s) for s in ("sa", "sb")}
    mean = {s: sums[s] / sum(n for k, _, n in strata if k == s) for s in sums}
    sources = spark.createDataFrame([("sa", sums["sa"], 1.7 * sums["sa"], mean["sa"]), ("sb", sums["sb"], 0.4 * sums["sb"], mean["sb"])], "skey string, source_size long, target double, mean_size double")
    for r in mixing.solve_dual(frame, sources).collect():
        got = sum(x * n * min(3.0, np.exp(r.lam * x / mean[r.skey])) for k, x, n in strata if k == r.skey)
        assert abs(got - r.target) < 1e-6 * r.target


def test_own_columns_and_empty(docs, none):
    out = mixing.mix(docs)
    assert out.columns == docs.columns + ["_size", "_source_size", "_target", "_copies"]  # own ones of these names stay
    assert {r["size"] for r in out.select("size").collect()} == {"x"}
    twice = mixing.mixed(docs)
    assert twice.columns == docs.columns
    assert twice.count() == out.agg({"_copies": "sum"}).first()[0]
    assert mixing.mix_report(none).count() == 0 and mixing.mixed(none).count() == 0
