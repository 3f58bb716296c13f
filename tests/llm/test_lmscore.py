import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corrente.llm import lmscore


def brute(texts):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts]
    counts = Counter(w for ts, h in zip(tokens, held, strict=True) if not h for w in ts)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(ts), sum(counts[w] > 0 for w in ts), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts), 6)) for (i, _), h, ts in zip(texts, held, tokens, strict=True)]


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_base_score(docs, texts, monkeypatch, head):
    monkeypatch.setattr(lmscore, "HEAD", head)
    out = lmscore.report(docs).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    for a, b in zip(sorted(got.elements(), key=str), sorted(brute(texts), key=str), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 * max(1, abs(b[5]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_score_beats_the_base_on_held_out_text(spark, sf):
    out = [r for r in lmscore.report(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 31, 20_000, dtype=np.uint64)) * np.uint64(2)
    n = np.minimum(rng.zipf(1.8, len(keys)), 10_000)
    shard = (np.arange(len(keys)) % 8).astype(np.int64)
    size = lambda n: int(np.ceil(lmscore._levels(n).sum() * lmscore.WORDS_A_KEY)) + 1
    f = lmscore.Filter(3, {s: lmscore.stretch(keys[shard == s], n[shard == s], size(n[shard == s])) for s in range(8)})
    level, true = f.level(shard, keys.astype(np.uint32)), lmscore._levels(n)
    assert (level >= true).all() and (level == true).mean() > 0.95
    other = rng.integers(0, 1 << 31, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.level(rng.integers(0, 8, len(other)), other.astype(np.uint32)) > 0).mean() < 0.02


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_score_is_that_of_a_plain_model(docs, texts, monkeypatch, most):
    """Exact counts, quantised by hand, discounted and added up word by word; the filter is broadcast or probed where its shards are."""
    monkeypatch.setattr(lmscore, "MAX_FILTER_BYTES", most)
    monkeypatch.setattr(lmscore, "WORDS_A_KEY", 1.0)  # so that next to nothing is found by mistake
    monkeypatch.setattr(lmscore, "FIRST_BITS", 10)
    level = lambda c: int(math.log2(c)) + 1 if c else 0
    mean = lambda x: float(x) if x <= 1 else 2 ** (x - 1) / math.log(2)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in texts]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in texts]
    words, both = Counter(), Counter()
    for ts, use in zip(tokens, train, strict=True):
        if use:
            words.update(ts)
            both.update(zip([None, *ts[:-1]], ts, strict=True))
    n, v = sum(words.values()), len(words)
    sizes = Counter(both.values())
    y = sizes[1] / (sizes[1] + 2 * sizes[2])
    d = [0, min(max(1 - 2 * y * sizes[2] / sizes[1], 0.1), 0.95), min(max(2 - 3 * y * sizes[3] / max(1, sizes[2]), 0.1), 1.9)]
    of = lambda a, b: (level(words[b]), level(words[a]), min(level(both[a, b]), level(words[a]), level(words[b])))
    taken, every = Counter(), Counter()
    for ts, use in zip(tokens, train, strict=True):
        for a, b in zip([None, *ts[:-1]], ts, strict=True) if use else ():
            _, h, p = of(a, b)
            every[h] += 1
            taken[h] += d[min(p, 2)] / mean(p) if p else 1.0
    want = []
    for (i, _), ts in zip(texts, tokens, strict=True):
        total = 0.0
        for a, b in zip([None, *ts[:-1]], ts, strict=True):
            w, h, p = of(a, b)
            mass = (taken[h] + 1) / (every[h] + 1) if h else 1.0
            total += math.log10(min(1.0, (max(mean(p) - d[min(p, 2)], 0) / max(mean(h), 1) if p else 0) + mass * (mean(w) + 1) / (n + v + 1)))
        want.append((str(i), len(ts), total))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lmscore.report(docs).collect())
    close = [abs(a[2] - b[2]) < 1e-6 * abs(b[2]) + 1e-9 for a, b in zip(got, sorted(want), strict=True)]
    assert np.mean(close) > 0.97, np.mean(close)


def test_filter_gives_the_same_scores_broadcast_or_in_shards(docs, monkeypatch):
    scores = []
    for most in (1 << 30, 0):
        monkeypatch.setattr(lmscore, "MAX_FILTER_BYTES", most)
        monkeypatch.setattr(lmscore, "BATCH_BYTES", 3000)
        scores.append(sorted(((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lmscore.report(docs).collect())))
    assert np.allclose([r[3] for r in scores[0]], [r[3] for r in scores[1]], rtol=1e-12)


def test_model_rests_on_every_training_token(spark, monkeypatch):
    seen, init = [], lmscore.Model.__init__
    monkeypatch.setattr(lmscore.Model, "__init__", lambda self, n, v, codes, d: seen.append(sum(codes.values())) or init(self, n, v, codes, d))
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('a b w', id % 50) AS text")
    assert lmscore.report(rows).first().train_tokens == seen[0] > 4 * 5000


def test_a_text_met_in_training_scores_above_a_new_one(spark):
    import random

    from conftest import WORDS

    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(80))
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, text()) for i in range(3000)]
    again = {held[k]: rows[held[k] + 1][1] for k in range(0, 100, 2) if held[k] + 1 not in held}
    out = {r.doc_id: r for r in lmscore.report(spark.createDataFrame([(i, again.get(i, t)) for i, t in rows], "doc_id long, text string")).collect()}
    new = [out[i].score - out[i].base_score for i in held if i not in again]
    assert min(out[i].score - out[i].base_score for i in again) > max(new)


def test_empty_and_nothing_to_learn(spark, none):
    assert lmscore.report(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lmscore.report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_a_code_of_very_many_tokens(spark, monkeypatch):
    """More tokens of one code than two bytes count."""
    seen, init = [], lmscore.Model.__init__
    monkeypatch.setattr(lmscore.Model, "__init__", lambda self, n, v, codes, d: seen.append(dict(codes)) or init(self, n, v, codes, d))
    use = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = spark.createDataFrame([(use[0], "ab " * 200_000), (use[1], "ab " * 65_536), (use[2], "cd")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lmscore.report(rows).collect()) == [2, 65_537, 200_001]
    assert sum(seen[0].values()) == 265_540 and max(seen[0].values()) == 265_534
