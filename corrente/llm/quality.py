"""Quality classifier by importance resampling.

Two bag-of-n-grams generative models over hashed unigrams and bigrams: one of
the target (documents labelled good), one of the raw corpus (all documents).
Besides words, n-grams of token shapes (case, punctuation, repetition of the
token before) are hashed too.  A document's weight is its log importance weight,
the sum over its n-grams of log target - log raw, divided by ``TEMPERATURE``
(neighbouring n-grams are far from independent, so the plain sum would be too
sure of itself).  The documents kept are the k of the largest perturbed weights,
weight + Gumbel noise: a sample without replacement in proportion to
exp(weight).  k is ``rate`` times the documents that have words; without a rate
it is the share of good ones among the labelled rows, taken as a sample of the
corpus.  So a document far from the cut is safe or lost, one near it is drawn.

The labelled rows come from a sample with a bound (``MAX_LABELLED`` expected of
each label), and those for which ``held_out`` is true are never learned from;
counts of the raw model cover all documents.  The k-th largest is found exactly
by narrowing histograms, without sorting or collecting rows.

Defined results.  Nulls: a null or empty text has no n-grams and is rejected.
Documents without a label, with several (any 0 wins), or with a null id only
count as raw.  Ties at the k-th place are all kept, and the noise follows from
the id and the text, so equal rows share their fate and reruns agree.  A very
long text is one document, read whole; its weight grows with its length.
Without labels of both kinds everything that has words is kept.  Clashing names:
own columns stay, an added column of the same name gets an underscore before its
name.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, arrow_limits, give_back, materialised, named, order_hash, over_batches, row_key, without
from .textscan import NONBLANK, WORD, Chunk, chunks, mix64, ngrams, row_of

WORD_BUCKETS, SHAPE_BUCKETS = 8192, 2048
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
MAX_LABELLED = 10_000
#: What the log importance weights are divided by, and of how many labelled rows one is held out.
TEMPERATURE, HOLD_OUT = 20.0, 4
_MARK = NONBLANK & ~WORD
_EDGES = 1024


def buckets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram: words and runs of punctuation, and pairs of neighbours."""
    ws, we, _ = chunk.words(WORD)
    ms, me, _ = chunk.words(_MARK)
    s, e = np.concatenate((ws, ms)), np.concatenate((we, me))
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    off = np.searchsorted(s, chunk.offsets)
    h = chunk.hashes(s, e)
    g, r = ngrams(h, off, 2)
    buf = chunk.buf
    upper = (buf >= 0x41) & (buf <= 0x5A)
    shape = upper[s] + 2 * upper[e - 1] + 4 * (buf[s] < 0x3A)
    again = np.append(False, h[1:] == h[:-1])[: len(h)]
    again[off[:-1][off[:-1] < len(h)]] = False  # the last token of another row is no neighbour
    shape = shape + 8 * again
    shape = shape.astype(np.uint64)
    mark = _MARK[buf[s]]
    shape[mark] = h[mark]
    t, tr = ngrams(mix64(shape + np.uint64(7)), off, 3, whole_short=True)
    words, shapes = np.uint64(WORD_BUCKETS), np.uint64(SHAPE_BUCKETS)
    return np.concatenate((mix64(h + np.uint64(1)) % words, g % words, words + t % shapes)).astype(np.int64), np.concatenate((row_of(off), r, tr))


def labelled_sample(labels: DataFrame, column: str, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y): at most about ``bound`` rows of each label, chosen by a hash of the id.  One row for an id; if its labels differ, 0 for quality and 1 for toxic wins (the smallest and the largest)."""
    pick = F.min if column == "quality" else F.max
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(pick(column).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in one.groupBy("y").agg(F.count("*")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, bound / max(1, counts.get(1, 0)))).otherwise(min(1.0, bound / max(1, counts.get(0, 0))))
    return one.where(F.pmod(order_hash("doc_id", seed="labelled " + column), F.lit(1 << 30)) < share * (1 << 30))


def held_out(doc_id: Column) -> Column:
    """Labelled rows that are not learned from, to measure on."""
    return F.pmod(order_hash(doc_id, seed="held out of quality"), F.lit(HOLD_OUT)) == 0


def fit(docs: DataFrame, sample: DataFrame, text_col: str, id_col: str) -> np.ndarray:
    """log target - log raw of every bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float)) == 1
            for chunk in chunks(batch.column(0)):
                b, r = buckets(chunk)
                raw += np.bincount(b, minlength=BUCKETS)
                target += np.bincount(b[good[chunk.first_row : chunk.first_row + chunk.n_rows][r]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["b", "raw", "target"])

    marked = docs.select(named(text_col).alias("text"), named(id_col).alias("doc_id")).join(F.broadcast(sample), "doc_id", "left").select("text", "y")
    rows = marked.mapInArrow(work, "b long, raw long, target long").groupBy("b").agg(F.sum("raw"), F.sum("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for b, x, y in rows:
        raw[b] += x
        target[b] += y
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighed(docs: DataFrame, ratio: np.ndarray, text: Column, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``weight`` (null without n-grams) of every document."""
    arrow_limits(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def work(texts: pa.Array) -> list[pa.Array]:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for chunk in chunks(texts):
            b, r = buckets(chunk)
            at = slice(chunk.first_row, chunk.first_row + chunk.n_rows)
            total[at] = np.bincount(r, model.value[b], chunk.n_rows)
            count[at] = np.bincount(r, minlength=chunk.n_rows)
        return [pa.array(total / TEMPERATURE, mask=count == 0)]

    return over_batches(docs, keep, [text], work, "weight double")


def with_gumbel(weight: Column, h: Column) -> Column:
    """A weight and the Gumbel noise of a hash: the k largest are a sample without replacement in proportion to exp(weight)."""
    u = (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a column of doubles (None: fewer, or k < 1), by histograms over ever narrower ranges."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while lo < hi:
        width = (hi - lo) / _EDGES
        inside = keys.where(F.col(column).between(lo, hi))
        if width <= 0 or lo + width == lo:
            return lo
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(_EDGES - 1)).cast("int")
        rows = sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for _, count, low, high in rows:
            if above + count >= k:
                lo, hi = low, high
                break
            above += count
        if len(rows) == 1 and rows[0][1] == 1:
            return lo
    return lo


def classify(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", columns: list[str] | None = None, rate: float | None = None, seed: int = 0) -> DataFrame:
    """The chosen columns (all, if not given) of every document with weight, perturbed and kept.  rate: the share of documents to keep; seed: of the noise."""
    arrow_limits(docs.sparkSession)
    sample = materialised(labelled_sample(labels, "quality").where(~held_out(F.col("doc_id"))))
    ratio = fit(docs, sample, text_col, id_col)
    columns = docs.columns if columns is None else columns
    names = [f"c{i}" for i in range(len(columns))]
    a, b = row_key(named(id_col), named(text_col))
    slim = docs.select(*[named(c).alias(n) for c, n in zip(columns, names, strict=True)], named(text_col).alias("text"), a.alias("a"), b.alias("b"))
    weights = materialised(weighed(slim, ratio, F.col("text"), [*names, "a", "b"]))
    sizes = {r[0]: r[1] for r in sample.groupBy("y").agg(F.count("*")).collect()}
    if rate is None:
        # of a sample with a bound for each label, the shares before the bound
        rate = good_share(labels) if sizes.get(0) and sizes.get(1) else 1.0
    n = weights.where("weight is not null").count()
    noisy = weights.withColumn("perturbed", with_gumbel(F.col("weight"), order_hash("a", "b", seed=f"gumbel {seed}")))
    k = round(rate * n)
    least = kth_largest(noisy, "perturbed", k) if k else float("inf")
    kept = F.coalesce(F.col("perturbed") >= (least if least is not None else float("-inf")), F.lit(False))
    return noisy.select(*[F.col(x).alias(c) for x, c in zip(names, columns, strict=True)], *[c.alias(added(columns, x)) for x, c in (("weight", F.col("weight")), ("perturbed", F.col("perturbed")), ("kept", kept))])


def good_share(labels: DataFrame) -> float:
    """The share of good documents among those with a label that may be learned from."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y")).where(~held_out(F.col("doc_id")))
    return one.agg(F.avg("y")).first()[0] or 0.0


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options: object) -> DataFrame:
    """The documents that are kept, with their columns.  Only keys of the rejected travel."""
    a, b = row_key(named(id_col), named(text_col))
    slim = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), a.alias("a"), b.alias("b"))
    out = classify(slim, labels, columns=["a", "b"], **options)
    return without(docs, out.where(~F.col("kept")).select("a", "b"), [a, b])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight, perturbed and kept of every document."""
    return classify(docs, labels, columns=["doc_id"])
