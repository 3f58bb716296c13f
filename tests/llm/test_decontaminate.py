import hashlib
import re
from collections import Counter

import pytest

from corrente.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, items):
    ws, hit, found = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.fixture(scope="module")
def items(texts):
    source = [t for _, t in texts if t and 50 < len(words(t)) < 400]
    out = [(i, " ".join(words(t)[3 : 3 + n])) for i, (t, n) in enumerate(zip(source[::7], (13, 14, 25, 40, 5, 2, 13, 60), strict=False))]
    out += [(100, None), (101, ""), (102, "two words"), (103, "never met anywhere at all"), (None, source[3]), (2, "café NAÏVE größe"), (2, "café NAÏVE größe"), (10, source[1][:200]), (9, source[1][:150]), (104, "Größe naïve")]
    return out


@pytest.mark.parametrize("windows", [50_000, 0])
def test_brute_force(spark, docs, texts, items, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    out = decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, out)) == Counter((i, *brute(t, items)) for i, t in texts)
    assert sum(r.contaminated for r in out) > 5 and not all(r.contaminated for r in out)


def test_stage_keeps_the_clean(spark, docs, texts, items):
    out = decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t in texts if not brute(t, items)[1])


def test_empty(spark, docs, none, items):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r.contaminated or r.n_hit or r.n_items for r in decontaminate.report(docs, no_items).collect())
