"""Toxic passages by maximum-scoring segments.

Every token gets its log-odds of standing in toxic against clean labelled text,
with an informative Dirichlet prior (the corpus shares of the token), shrunk to
its lower confidence limit.  Only tokens whose log-odds stand ``LEAST_Z``
standard deviations above 0 count as evidence; every other token, clean ones
included, costs ``DRIFT``, so that chance segments drift down.  A linear-time
scan (Ruzzo and Tompa) finds all maximal segments of a text.  The extreme-value
law of such maxima gives a segment of score S in a text of n tokens the expected
number K n exp(-lambda S) of chance segments as high; lambda solves
E[exp(lambda s)] = 1 over clean tokens, and K is the rate of high segments in a
long sequence of such tokens drawn at random.  The log-scores of all significant
segments of a text, so normalised, add up to its evidence, which a logistic
curve fitted on the training labels turns into a score from 0 to 1.

Labels are learned from a sample with a bound (``MAX_LABELLED`` expected rows of
each label), of which about one text of each group of near copies counts: texts
of one label that share the least hash of their three-word shingles in any of
``_MINHASHES`` orders, those of the least text hash staying.  The model's size is
a parameter too: its ``MAX_TOKENS`` strongest tokens.  Scoring reads every whole
text.

Defined results.  Nulls: a null or empty text has no tokens, thus no segment and
the lowest score.  A null id counts as the empty text.  Ids with several labels
are toxic if any is.  Without labels of both kinds every score is 0.  Ties:
segments of equal score all count; equal texts get equal scores, and the same
rows in other partitions the same model.  A very long text is one sequence, read
to the end.  Clashing names: kept columns stay, an added column of the same name
gets an underscore before its name.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, arrow_limits, id_remainder, materialised, named, order_hash, over_batches
from .quality import labelled_sample
from .textscan import WORD, Chunk, chunks, counted, mix64, ngrams, row_of, signed

MAX_LABELLED, MAX_TOKENS = 8000, 1 << 16
#: Texts that the prior of a token weighs; toxic and clean text share them in proportion to their sizes, so that without evidence the log-odds are 0.
PRIOR = 1.0
#: Least log-odds in standard deviations of a token with evidence.
LEAST_Z = 3.2
DRIFT, LEAST_SCORE, MAX_TOKEN_SCORE = -0.25, 0.5, 6.0
THRESHOLD = 0.7
_STEMS = (4, 6)
#: Random tokens that K is estimated from, and the highest of their segments that tell it.
_DRAWN, _HIGHEST = 400_000, 200
_MINHASHES = 6


def tokens(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of the words, hashes of their first bytes (stems, one array a length), and where each row's words begin."""
    s, e, off = chunk.words(WORD)
    h = chunk.hashes(s, e)
    stems = [mix64(chunk.hashes(s, np.minimum(e, s + n)) + np.uint64(n)) for n in _STEMS]
    return h, stems, off


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments.

    places: positions of the tokens of positive score, ascending; every other token scores ``drift``.  A candidate is kept as (total before it, total at its end); a new one is joined to the nearest earlier candidate of lower start total whose end total is lower than its own."""
    found: list[list[float]] = []  # first, last, total before, total after
    back: list[int] = []
    total, last = 0.0, -1
    for p, s in zip(places, scores, strict=True):
        total += drift * (p - last - 1)
        first, low = p, total
        total += s
        last = p
        high = total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = back[j]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:], back[j:]
            j = len(found) - 1
        found.append([first, p, low, high])
        back.append(j)
    return [(int(a), int(b), y - x) for a, b, x, y in found]


class Model:
    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.lam, self.log_k, self.curve = 1.0, 0.0, (1.0, -5.0)

    def look(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if len(self.keys):
            maybe = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            x = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == x, self.scores[at], 0.0)
        return out

    def token_scores(self, h: np.ndarray, stems: list[np.ndarray]) -> np.ndarray:
        s = self.look(h)
        for x in stems:
            s = np.maximum(s, self.look(x))
        return np.where(s >= LEAST_SCORE, s, DRIFT)

    def calibrate(self, values: np.ndarray, counts: np.ndarray) -> None:
        """lambda and K from the scores of clean tokens and their counts; one token more stands for any kind not seen there."""
        values, p = np.append(values, MAX_TOKEN_SCORE), np.append(counts, 1.0)
        p = p / p.sum()
        lo, hi = 1e-6, 50.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (lo, mid)
        self.lam = lo
        found = np.sort(chance_segments(values, p, 1))[::-1]
        high = found[: max(1, min(_HIGHEST, len(found) // 4))]
        self.log_k = float(np.log(len(high) / _DRAWN) + lo * high[-1]) if len(high) else float(-np.log(_DRAWN))

    def evidence(self, chunk: Chunk, spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Of each row: the sum over its segments of lambda S - ln(K n), where above 0; and those segments, in tokens."""
        h, stems, off = tokens(chunk)
        s = self.token_scores(h, stems)
        up = np.flatnonzero(s > 0)
        out, where = np.zeros(chunk.n_rows), [[] for _ in range(chunk.n_rows)] if spans else []
        cut = np.searchsorted(up, off)
        for row in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[row], cut[row + 1]
            base = off[row]
            bar = self.log_k + np.log(off[row + 1] - base)
            for first, last, score in maximal_segments((up[a:b] - base).tolist(), s[up[a:b]].tolist(), DRIFT):
                x = self.lam * score - bar
                if x > 0:
                    out[row] += x
                    if spans:
                        where[row].append((first, last + 1, x))
        return out, where

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))


def chance_segments(values: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Scores of the maximal segments of ``_DRAWN`` independent tokens."""
    drawn = np.random.default_rng(seed).choice(values, _DRAWN, p=p)
    up = np.flatnonzero(drawn > 0)
    return np.array([x for *_, x in maximal_segments(up.tolist(), drawn[up].tolist(), DRIFT)])


def token_table(docs: DataFrame) -> DataFrame:
    """(h, tox, clean, dtox, dclean): occurrences and documents of each token and stem in (text, y)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for chunk in chunks(batch.column(0)):
                h, stems, off = tokens(chunk)
                r = row_of(off)
                y = toxic[chunk.first_row : chunk.first_row + chunk.n_rows]
                row, key, n = counted(np.concatenate([r] * (1 + len(stems))), np.concatenate((h, *stems)))
                keys, at = np.unique(key, return_inverse=True)
                is_y = y[row]
                sums = [np.bincount(at, w, len(keys)).astype(np.int64) for w in (n * is_y, n * ~is_y, is_y, ~is_y)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), *map(pa.array, sums)], names=["h", "tox", "clean", "dtox", "dclean"])

    parts = docs.mapInArrow(work, "h long, tox long, clean long, dtox long, dclean long")
    return parts.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("tox", "clean", "dtox", "dclean")])


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """About one text of each group of exact or near copies, as the words of a copied text are no evidence for each other: those that share the least hash of their shingles, in any of some orders, count as copies."""
    names = [f"m{i}" for i in range(_MINHASHES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.zeros((_MINHASHES, batch.num_rows), np.uint64)
            for chunk in chunks(batch.column(0)):
                s, e, off = chunk.words(WORD)
                g, r = ngrams(chunk.hashes(s, e), off, 3, whole_short=True)
                for i in range(_MINHASHES):
                    x = np.full(chunk.n_rows, np.iinfo(np.uint64).max)
                    np.minimum.at(x, r, mix64(g + np.uint64(i + 11)))
                    least[i, chunk.first_row : chunk.first_row + chunk.n_rows] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(signed(x)) for x in least)], names=["text", "y", *names])

    out = sample.select("text", "y").mapInArrow(work, "text string, y int, " + ", ".join(f"{n} long" for n in names))
    out = materialised(out.withColumn("a", order_hash("text", seed="copy")))
    stay = out.select("a", "y", *names)
    for n in names:
        rest = ["a", *(x for x in names if x != n)]
        stay = stay.groupBy("y", n).agg(F.min(F.struct(*rest)).alias("first")).select("y", n, "first.*")
    return materialised(out.join(stay.select("a", "y"), ["a", "y"], "left_semi").dropDuplicates(["a", "y"]).select("text", "y"))


def learn(sample: DataFrame) -> Model | None:
    """sample: (text, y)."""
    sample = _one_of_copies(sample)
    sizes = {r[0]: r[1] for r in sample.groupBy("y").agg(F.count("*")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    table = materialised(token_table(sample))
    n_tox, n_clean = (float(x or 0) for x in table.agg(F.sum("dtox"), F.sum("dclean")).first())
    if not n_tox or not n_clean:
        return None
    # a token counts once a text
    tox, clean = F.col("dtox") + PRIOR * n_tox / (n_tox + n_clean), F.col("dclean") + PRIOR * n_clean / (n_tox + n_clean)
    odds = lambda y, n: F.log(y / (n + PRIOR - y))
    delta = odds(tox, n_tox) - odds(clean, n_clean)
    sd = F.sqrt(1 / tox + 1 / clean)
    strong = table.where("dtox >= 2").withColumn("s", F.least(delta - sd, F.lit(MAX_TOKEN_SCORE))).where(F.col("s") >= LEAST_SCORE).where(delta / sd >= LEAST_Z)
    rows = strong.select("h", "s").orderBy(F.desc("s"), "h").limit(MAX_TOKENS).collect()
    model = Model(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], float))
    sc = sample.sparkSession.sparkContext
    sent = sc.broadcast(model)

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = batch.column(1).to_numpy(zero_copy_only=False) == 0
            for chunk in chunks(batch.column(0)):
                h, stems, off = tokens(chunk)
                keep = clean[chunk.first_row : chunk.first_row + chunk.n_rows][row_of(off)]
                v, n = np.unique(np.round(sent.value.token_scores(h, stems)[keep], 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["v", "n"])

    found = sample.mapInArrow(clean_counts, "v double, n long").groupBy("v").agg(F.sum("n")).collect()  # at most 10 x MAX_TOKEN_SCORE values
    values, counts = np.array([r[0] for r in found] or [DRIFT]), np.array([r[1] for r in found] or [1])
    model.calibrate(values, counts.astype(float))
    rows = sorted(map(tuple, _evidence(sample, model, ("y",)).select("y", "x").collect()))  # of the sample
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    model.curve = logistic(np.log1p(x), y)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small ridge; both labels weigh the same."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    z, t = np.column_stack((x, np.ones(len(x)))), np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -40, 40)))
        g = z.T @ (w * (p - y)) + 1e-2 * t
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return max(float(t[0]), 1e-6), float(t[1])


def _evidence(docs: DataFrame, model: Model, keep: tuple[str, ...], spans: bool = False, text_col: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TOKENS entries
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("evidence", pa.float64())]))

    def work(texts: pa.Array) -> list[pa.Array]:
        x, where = np.zeros(len(texts)), []
        for chunk in chunks(texts):
            x[chunk.first_row : chunk.first_row + chunk.n_rows], segments = sent.value.evidence(chunk, spans)
            where += segments
        return [pa.array(x)] + ([pa.array([[dict(zip(("first", "after", "evidence"), s, strict=True)) for s in r] for r in where], kind)] if spans else [])

    fields = "x double" + ", passages array<struct<first: int, after: int, evidence: double>>" * spans
    return over_batches(docs, keep, [named(text_col)], work, fields)


def score_toxicity(docs: DataFrame, sample: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), spans: bool = False, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, score and (with ``spans``) the significant passages, as positions of tokens, of every row."""
    arrow_limits(docs.sparkSession)
    model = learn(sample)
    own, score, passages = [named(c) for c in keep], added(keep, "score"), added(keep, "passages")
    if model is None:
        return docs.select(*own, F.lit(0.0).alias(score), *([F.array().cast("array<struct<first: int, after: int, evidence: double>>").alias(passages)] if spans else []))
    a, b = model.curve
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * F.log1p(named(added(keep, "x"))) + b))))
    return _evidence(docs, model, keep, spans, text_col).select(*own, p.alias(score), *([named(passages)] if spans else []))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    known = materialised(labelled_sample(labels.where(id_remainder(F.col("doc_id"), 3) != 1), "toxic", MAX_LABELLED))
    sample = materialised(slim.join(F.broadcast(known), "doc_id").select("text", "y"))  # about 2 x MAX_LABELLED rows
    out = score_toxicity(slim, sample, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
