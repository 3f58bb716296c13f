import numpy as np
import pytest
from conftest import sentence

from corrente.llm import quality
from corrente.llm.common import order_hash


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=500), [2.5] * 40, [1e9, -1e9]))
    frame = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for k in (1, 2, 30, 200, 542):
        assert quality.kth_largest(frame, "v", k) == np.sort(x)[-k]
    assert quality.kth_largest(frame, "v", 543) is None and quality.kth_largest(frame, "v", 0) is None


def test_inclusion_follows_the_weights(spark):
    """Over many seeds: of five documents the first of the sample is drawn in proportion to exp(weight), the pair of the first two as a sample without replacement."""
    w = [0.0, 0.5, 1.0, 1.5, -1.0]
    frame = spark.range(6000).selectExpr("id draw", f"posexplode(array({', '.join(map(str, w))})) as (i, w)")
    noisy = frame.withColumn("p", quality.with_gumbel(frame.w, order_hash("i", "draw", seed="test"))).toPandas()
    first_two = noisy.sort_values("p", ascending=False).groupby("draw").head(2).groupby("draw")["i"].apply(list)
    e = np.exp(w)
    p = e / e.sum()
    for i in range(5):
        assert abs((first_two.str[0] == i).mean() - p[i]) < 0.025
        other = sum(p[j] * p[i] / (1 - p[j]) for j in range(5) if j != i)
        assert abs(first_two.apply(lambda x, i=i: i in x).mean() - p[i] - other) < 0.025


def test_noise_decides_near_the_cut_and_rate_is_kept(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(len(t or "") % 3 != 0), 0) for i, t in texts if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int")
    some, n = [], sum(bool(t and t.strip()) for _, t in texts)
    for seed in range(3):
        out = quality.classify(docs, labels, columns=["doc_id"], rate=0.5, seed=seed).collect()
        some.append(sorted((r.doc_id is None, r.doc_id or 0, r.weight or 0, r.kept) for r in out))
        assert n / 2 - 1 <= sum(r.kept for r in out) <= n / 2 + 3
        by_weight = sorted((r.weight for r in out if r.weight is not None), reverse=True)[: round(n / 2)]
        changed = sum(r.kept != (r.weight is not None and r.weight >= by_weight[-1]) for r in out)
        assert changed > 0
    assert some[0] != some[1] != some[2]


def test_held_out_labels(spark, sf):
    """On labelled rows that the models and the rate have not seen."""
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.report(frame, labels).select("doc_id", "kept")
    rows = labels.where(quality.held_out(labels.doc_id)).join(kept, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert len(good) > 50 and np.mean(good) > 0.93 and np.mean(bad) < 0.25, (np.mean(good), np.mean(bad))


def test_own_columns_stay(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.columns == docs.columns + ["_weight", "perturbed", "_kept"] and {r["weight"] for r in out.select("weight").collect()} == {"x"}
    stay = quality.accepted(docs, labels)
    assert stay.columns == docs.columns and stay.count() == out.where("_kept").count()
    assert quality.accepted(none, labels).count() == 0


def test_weights_and_choice_are_those_of_a_plain_model(spark, docs, texts):
    """The weights again from counts of the buckets, then the Gumbel top-k by sorting."""
    import pyarrow as pa

    from corrente.llm.textscan import chunks

    known = {i: int(len(t or "") % 3 != 0) for i, t in texts if i is not None and i % 2 == 0}
    labels = spark.createDataFrame([(i, y, 0) for i, y in known.items()] + [(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.report(docs, labels).collect()
    learned = {r.doc_id for r in labels.where(~quality.held_out(labels.doc_id)).collect()}
    sizes = {}

    def spread(text):
        grams = [b for c in chunks(pa.array([text or ""])) for b in quality.buckets(c)[0].tolist()]
        return np.bincount(grams, minlength=quality.BUCKETS) if grams else np.zeros(quality.BUCKETS, int)

    every = [spread(t) for _, t in texts]
    raw = 1 + sum(every)
    target = 1 + sum((e for e, (i, _) in zip(every, texts, strict=True) if i in learned and known.get(i) == 1), np.zeros(quality.BUCKETS, int))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for e, (i, _) in zip(every, texts, strict=True):
        n = e.sum()
        sizes.setdefault(i, []).append((e @ ratio) / quality.TEMPERATURE if n else None)
    for i, expect in sizes.items():
        mine = [r.weight for r in got if r.doc_id == i]
        assert mine.count(None) == expect.count(None)
        assert sorted(x for x in mine if x is not None) == pytest.approx(sorted(x for x in expect if x is not None), rel=1e-6, abs=1e-6)
    noisy = sorted((r.perturbed for r in got if r.perturbed is not None), reverse=True)
    kept = [r for r in got if r.kept]
    assert 0 < len(kept) < len(got) and sorted((r.perturbed for r in kept), reverse=True) == noisy[: len(kept)]
    assert not any(r.kept for r in got if r.weight is None)


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(2)
    junk = lambda: " ".join(rng.choice(["@@", "$$$", "buy", "BUY", "NOW!!!", "click", "zz"]) for _ in range(60))
    rows = [(i, junk() if i % 4 == 0 else sentence(rng, 60)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.report(frame, labels).where("kept").collect()}
    assert len(kept ^ {i for i in range(400) if i % 4}) <= 16


def test_without_labels_and_empty(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.report(docs, labels).collect()
    assert all(r.kept == (r.weight is not None) for r in out)
    assert quality.report(none, labels).count() == 0
