"""Each stage against what its operator says, on its own input."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from corrente.llm import decontaminate, mixing, neardup, quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns + (["shard", "slot"] if name == "shard" else [])
        out.write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
    after = dict(zip(seen, [*list(seen.values())[1:], docs], strict=True))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(after["quality"]) == ids(quality.report(seen["quality"], labels).where("kept"))
    assert ids(after["near_dedup"]) == ids(neardup.report(seen["near_dedup"]).where("kept"))
    assert ids(after["decontaminate"]) == ids(decontaminate.report(seen["decontaminate"], items).where("n_hit = 0"))
    taken = mixing.mix_report(seen["mix"]).where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int")).collect()
    assert ids(after["mix"]) == Counter(dict(map(tuple, taken)))
    counts = [r[1] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(13, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_no_planted_passage_stays_in_texts_of_any_length(spark):
    """A plain search beside the stage: passages of benchmark planted in texts of 300 to 20,000 words."""
    import random

    from conftest import sentence

    rng = random.Random(9)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = []
    for i in range(60):
        words = sentence(rng, rng.choice((300, 1000, 5000, 20_000))).split()
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items).split()
        rows.append((i, " ".join(words), "en", "web", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.decontaminate_stage(spark, docs, SMALL)
    bad = set().union(*map(windows, items))
    assert {r.doc_id for r in out.collect()} == {i for i, t, *_ in rows if not windows(t) & bad} == {i for i in range(60) if i % 3}


def test_own_columns_pass_all_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and {r["size"] for r in out.select("size").collect()} == {"x"}, name
    assert set(docs.columns) < set(corpus_pipeline.shard_stage(spark, docs, SMALL).columns)
