import zlib

import numpy as np

from corrente.llm import langid


def test_held_out_accuracy(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in langid.report(frame).collect()}
    right = total = 0
    for r in frame.collect():
        p = out[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= p.score <= 1
        if p.held_out and len(r.text) > 60 and r.lang is not None:
            right, total = right + (p.lang_pred == r.lang), total + 1
    assert total > 100 and right / total > 0.93, right / total


def test_only_the_text_decides(spark, docs, none):
    frame = docs.select("doc_id", "text", "lang", "source", "score")
    out = langid.report(frame).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r, d in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(frame.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        if d.doc_id is not None and d.doc_id != 5:
            assert by_text.setdefault(d.text, r.lang_pred) == r.lang_pred
        if d.doc_id is not None and d.doc_id != 5 and not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.report(none).count() == 0
    unknown = langid.report(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).collect()
    assert unknown[0].lang_pred == "und"


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = np.column_stack((rng.normal(size=(200, 2)) + np.repeat([[2, 2], [-2, -2]], 100, 0), np.ones(200)))
    y = np.repeat([1.0, -1.0], 100)
    assert ((x @ langid.svm(x, y) > 0) == (y > 0)).mean() > 0.98


def test_families():
    assert langid.family("de-AT") == "germanic" == langid.family("en") and langid.family("fr") == "romance" and langid.family("xx") == "only xx"


def test_votes_are_those_of_a_plain_count():
    """Fixed weights: margins trigram by trigram, wins and margins counted machine by machine."""
    import math

    import pyarrow as pa

    rng = np.random.default_rng(6)
    model = langid.Model(["de", "en", "es", "fr", "it", "ru"])
    model.w = rng.normal(size=model.w.shape).astype(np.float32)
    texts = ["Größe und Klang " * 3, "one two", "été à Paris", "x", "ab", "слова", "A1 b2", None]
    best, score = model.predict(model.margins(pa.array(texts)))
    for i, t in enumerate(texts):
        folded = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in (t or "").encode())
        grams = [folded[j : j + 3] for j in range(len(folded) - 2)]
        codes = [((g[0] | g[1] << 8 | g[2] << 16) * 2654435761 % (1 << 32)) >> 20 for g in grams]
        margin = [sum(float(w[c]) for c in codes) / max(1, len(codes)) for w in model.w]

        def contest(level, classes, margin=margin):
            rank, sure = {}, {}
            for c in classes:
                own = [m if a == c else -m for (kind, a, b), m in zip(model.tasks, margin, strict=True) if kind == level and c in (a, b)]
                wins = [m >= 0 if a == c else m < 0 for (kind, a, b), m in zip(model.tasks, margin, strict=True) if kind == level and c in (a, b)]
                rank[c] = sum(wins) + 1e-3 * math.tanh(sum(own) / 10)
                sure[c] = min([1 / (1 + math.exp(-m)) for m in own], default=1.0)
            return rank, sure

        rank, sure = contest("family", range(len(model.families)))
        top = max(rank, key=rank.get)
        rank2, sure2 = contest("lang", range(len(model.names)))
        want = max((n for n in rank2 if model.of[n] == top), key=rank2.get)
        assert best[i] == want and abs(score[i] - sure[top] * sure2[want]) < 1e-6, t


def test_own_columns_stay(spark, docs):
    out = langid.identify(docs, docs.selectExpr("text", "lang", "doc_id h"), keep=("doc_id", "score", "a.b", "lang"))
    assert out.columns == ["doc_id", "score", "a.b", "lang", "lang_pred", "_score"] and out.count() == docs.count()
