import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corrente.llm import toxicity


def brute(s):
    """By definition: the best segment (the longest of those; of equal ones the first), then both sides again."""

    def inside(lo, hi):
        best, at = 0.0, None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += s[b]
                if total > best + 1e-9 or (at and abs(total - best) <= 1e-9 and b - a > at[1] - at[0]):
                    best, at = max(total, best), (a, b)
        if at is None:
            return []
        return inside(lo, at[0]) + [(*at, round(best, 6))] + inside(at[1] + 1, hi)

    return inside(0, len(s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-0.25, -0.25, -0.25, 0.7, 1.3, 2.9]), max_size=25))
def test_segments_hold_every_best_one(s):
    places = [i for i, x in enumerate(s) if x > 0]
    got = [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(places, [s[i] for i in places], -0.25)]
    expect = brute(s)
    assert round(max((x for *_, x in got), default=0), 6) == round(max((x for *_, x in expect), default=0), 6)
    assert sum(x for *_, x in got) == sum(x for *_, x in expect) or abs(sum(x for *_, x in got) - sum(x for *_, x in expect)) < 1e-6
    assert all(abs(sum(s[a : b + 1]) - x) < 1e-6 for a, b, x in got)


def test_held_out(spark, sf):
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.report(frame, labels).collect()}
    assert len(out) == frame.count()
    rows = [(out[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in out]
    for p, _ in rows:
        assert p.held_out == (zlib.crc32(str(p.doc_id).encode()) % 3 == 1) and 0 <= p.score <= 1 and p.predicted == int(p.score >= 0.7)
    held = [(p.score, y) for p, y in rows if p.held_out]
    pos, neg = np.array([s for s, y in held if y == 1]), np.array([s for s, y in held if y == 0])
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.85, auc
    assert (neg >= 0.7).mean() < 0.1


def test_false_alarms_are_as_many_as_the_law_says():
    """The expected number K n exp(-lambda S) of chance segments, on tokens drawn anew."""
    values, counts = np.array([-0.25, 0.7, 1.4, 2.8, 5.0]), np.array([9300.0, 400, 200, 80, 20])
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0))
    model.calibrate(values, counts)
    v, p = np.append(values, toxicity.MAX_TOKEN_SCORE), np.append(counts, 1.0) / (counts.sum() + 1)
    found = np.concatenate([toxicity.chance_segments(v, p, seed) for seed in range(10, 20)])
    for bar in (10.0, 14.0):
        expect = np.exp(model.log_k + np.log(10 * toxicity._DRAWN) - model.lam * bar)
        assert 0.6 < (found >= bar).sum() / expect < 1.6, (bar, (found >= bar).sum(), expect)


def test_scores_are_those_of_a_plain_model(spark):
    """Evidence of each text from the token scores, by the plain search for best segments, and the curve."""
    import pyarrow as pa

    from corrente.llm.textscan import chunks

    rng = np.random.default_rng(4)
    quiet, vile = [f"quiet{i}" for i in range(60)], [f"vile{i}" for i in range(8)]
    text = lambda bad: " ".join([*rng.choice(quiet, 30), *(rng.choice(vile, 6) if bad else []), *rng.choice(quiet, 20)])
    sample = spark.createDataFrame([(text(i % 4 == 0), int(i % 4 == 0)) for i in range(240)], "text string, y int")
    rows = [(i, text(i % 5 == 0)) for i in range(40)] + [(90, None), (91, ""), (92, "vile1 " * 9)]
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), sample).collect()}
    model = toxicity.learn(sample)
    assert len(model.keys)
    for i, t in rows:
        (chunk,) = chunks(pa.array([t or ""]))
        h, stems, _ = toxicity.tokens(chunk)
        scores = model.token_scores(h, stems).tolist()
        bar = model.log_k + np.log(max(len(scores), 1))
        x = sum(max(0.0, model.lam * s - bar) for *_, s in brute(scores))
        assert abs(out[i] - model.probability(np.log1p(np.array([x])))[0]) < 1e-6
    assert min(out[i] for i in range(0, 40, 5)) > max(out[i] for i in range(40) if i % 5)


def test_other_partitions_give_the_same_scores(spark, sf):
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r.doc_id: r.score for r in toxicity.report(frame, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.report(frame.repartition(7), labels.repartition(3)).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_passages_nulls_and_empty(spark, docs, none):
    rows = [(i, ("quiet words of a calm text " * 6) + ("vile nasty slur hateful scum " * 4 if i % 3 == 0 else "") + f"number{i} ends") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in rows], "text string, y int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(frame, sample, spans=True).collect()}
    assert all(0 <= r.score <= 1 for r in out.values())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.report(docs, labels).collect()} == {0.0}
    assert toxicity.report(none, labels).count() == 0
    mixed = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.report(docs, mixed).count() == docs.count()
    keep = toxicity.score_toxicity(docs, sample, keep=("score", "x", "a.b"), spans=True)
    assert keep.columns == ["score", "x", "a.b", "_score", "passages"] and keep.count() == docs.count()
