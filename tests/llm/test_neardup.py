import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrente.llm import neardup


def bag(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return tuple(words), {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def similarity(a, b):
    """By definition: over common elements d, 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute_classes(texts):
    """Class (as a set of places) of each place."""
    bags = [bag(t) for _, t in texts]
    distinct = list({w: x for w, x in bags if w}.items())
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sizes = [sum(x.values()) for _, x in distinct]
    for i in range(len(distinct)):
        for j in range(i):
            common = distinct[i][1].keys() & distinct[j][1].keys()
            if len(common) > 0.5 * min(len(distinct[i][1]), len(distinct[j][1])) and 0.5 < sizes[i] / sizes[j] < 2 and similarity(distinct[i][1], distinct[j][1]) >= 0.8 - 1e-9:
                parent[root(i)] = root(j)
    of = {w: root(i) for i, (w, _) in enumerate(distinct)}
    groups = defaultdict(set)
    for k, (w, _) in enumerate(bags):
        groups[("none", k) if not w else of[w]].add(k)
    return groups.values()


@pytest.mark.parametrize("bits", [64, 5])
def test_classes_are_those_of_brute_force(spark, texts, bits):
    """Also where the hashes of unlike texts agree."""
    # the place of a row is its id here, so that ids are unique
    found = neardup.classes(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3), bits=bits).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.class_id].add(r.id)
    expect = {frozenset(g) for g in brute_classes(texts)}
    assert {frozenset(g) for g in groups.values()} == expect
    assert any(len(g) > 2 for g in expect)
    for r in found:
        assert r.class_id == min(groups[r.class_id]) and r.class_size == len(groups[r.class_id]) and r.kept == (r.id == r.class_id)


def test_deduplicated_keeps_one_row_of_each_class_with_its_columns(docs, texts):
    out = neardup.deduplicated(docs).collect()
    assert list(out[0].asDict()) == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out)
    for group in brute_classes(texts):
        assert sum(kept[x] for x in {texts[k] for k in group}) >= 1
    assert len(out) == len(list(brute_classes(texts)))


def test_report_has_all_rows(docs):
    out = neardup.report(docs)
    assert out.columns == ["doc_id", "class_id", "class_size", "kept"] and out.count() == docs.count()


def test_empty(none):
    assert neardup.report(none).count() == 0
    assert neardup.deduplicated(none).columns == none.columns and neardup.deduplicated(none).count() == 0


def test_both_ways_of_joining_links_agree(spark):
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b], "k long, p long")
    one, rounds = ({(r.k, r.c) for r in neardup.components(edges, local).collect()} for local in (10_000, 0))
    assert one == rounds and len(one) > 100


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    keys = neardup.mix64(np.arange(1, 301, dtype=np.uint64))
    w = 1 + np.log(rng.integers(1, 9, 300))
    a, b = slice(0, 220), slice(60, 300)
    rows = np.repeat([0, 1], (220, 240))
    sig = neardup.prob_minhash(rows, np.concatenate((keys[a], keys[b])), np.concatenate((w[a], w[b])), 2, 4000)
    x, y = np.sort(keys[a]), np.sort(keys[b])
    weigh = dict(zip(keys.tolist(), w.tolist(), strict=True))
    exact = neardup.probability_jaccard(x, np.array([weigh[k] for k in x.tolist()]), y, np.array([weigh[k] for k in y.tolist()]))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    assert abs(exact - similarity({k: weigh[k] for k in x.tolist()}, {k: weigh[k] for k in y.tolist()})) < 1e-9


@pytest.mark.parametrize(("paired", "few"), [(1000, 20_000), (32, 20_000), (1, 0)])
def test_a_family_below_the_threshold_hides_no_pairs(spark, monkeypatch, paired, few):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "FEW_PAIRS", few)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    base = " ".join(f"w{i}" for i in range(200))
    # two texts of the family are 196 / 254 alike, those of a planted pair 206 / 244
    tails = [[f"t{i}x{j}" for j in range(29)] for i in range(300)]
    for i in range(0, 30, 2):
        tails[i + 1][:10] = tails[i][:10]
    rows = [(i, base + " " + " ".join(t)) for i, t in enumerate(tails)]
    out = {r.doc_id: r.class_id for r in neardup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i - 1 if i < 30 and i % 2 else i for i in range(300)}


def test_bags_hold_large_counts(spark):
    held = neardup.bags(spark.createDataFrame([("a " * 70_004,)], "text string"), F.col("text")).first().bag
    assert np.allclose(neardup.opened_bag(held)[1], [1 + math.log(70_000)])


def test_large_group_stays_linear(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, base + f" v{i}") for i in range(300)]
    out = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.countDistinct("class_id"), F.max("class_size")).first()
    assert tuple(out) == (1, 300)


def test_every_similar_pair_shares_a_rare_shingle():
    """The prefix rule itself: pairs at the threshold or above have a shingle in common among the rarest of each."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.integers(1, 5)):
            t[rng.integers(0, 120)] = f"x{rng.integers(0, 30)}"
        texts.append(" ".join(t))
    bags_ = [bag(t)[1] for t in texts]
    count = Counter(g for b in bags_ for g in b)
    prefixes = []
    for b in bags_:
        total, before, some = sum(b.values()), 0.0, set()
        for g in sorted(b, key=lambda g: (count[g], g)):
            if total - before >= 0.8 * total:
                some.add(g)
            before += b[g]
        prefixes.append(some)
    pairs = [(i, j) for i in range(60) for j in range(i) if similarity(bags_[i], bags_[j]) >= 0.8]
    assert len(pairs) > 50 and all(prefixes[i] & prefixes[j] for i, j in pairs)


def test_blocks_meet_a_pair_once(spark, monkeypatch, tmp_path):
    """Entries of one family share many rare shingles each; the pairs that blocks compare are those of the family, not those of each shingle."""
    compare = neardup._similar_across

    def noted(key, table):
        own = table["own"].to_numpy()
        first, second = (own == key[1].as_py()).sum(), (own == key[2].as_py()).sum()
        pairs = first * second if key[1].as_py() != key[2].as_py() else first * (first - 1) // 2
        (tmp_path / "-".join(str(x.as_py()) for x in key)).write_text(str(pairs))
        return compare(key, table)

    monkeypatch.setattr(neardup, "_similar_across", noted)
    monkeypatch.setattr(neardup, "PAIRED", 4)
    monkeypatch.setattr(neardup, "BLOCK", 60)
    rng, rows = np.random.default_rng(7), []
    for i in range(200):
        words = [f"w{x}" for x in range(300)]
        for x in rng.choice(300, rng.integers(3, 8), replace=False):
            words[x] = f"t{i}x{x}"
        rows.append((i, " ".join(words)))
    out = {r.doc_id: r.class_id for r in neardup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags_, expect = [bag(t)[1].keys() for _, t in rows], list(range(200))
    for i in range(200):
        for j in range(i):
            # no shingle occurs twice, so all weigh 1
            if len(bags_[i] & bags_[j]) >= 0.8 * len(bags_[i] | bags_[j]):
                expect = [min(expect[i], expect[j]) if c in (expect[i], expect[j]) else c for c in expect]
    assert [out[i] for i in range(200)] == expect and len(set(expect)) > 10
    assert 0 < sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 200 * 199 // 2


@pytest.mark.parametrize("few", [1, 16, 10_000])
@pytest.mark.parametrize("cut", [0, 17])
def test_shared_weight_by_both_ways(monkeypatch, few, cut):
    monkeypatch.setattr(neardup, "FEW_OF", few)
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", 100)
    rng = np.random.default_rng(4)
    bags_ = [{int(k): float(w) for k, w in zip(rng.choice(200, 30, replace=False) // rng.integers(1, 9), rng.uniform(1, 3, 30), strict=True)} for _ in range(40)]
    row = np.repeat(np.arange(40), [len(b) for b in bags_])
    _, at = np.unique([k for b in bags_ for k in b], return_inverse=True)
    out = neardup.shared_weight(row, at, np.array([w for b in bags_ for w in b.values()]), 40, cut)
    for x in range(40):
        for y in range(40):
            if x != y and (not cut or (x < cut) != (y < cut)):
                assert abs(out[x, y] - sum(w for k, w in bags_[x].items() if k in bags_[y])) < 1e-9
