"""Hierarchical language identification.

First the language family, then the language within it.  At both levels every
two classes have a linear support vector machine (squared hinge, dual coordinate
descent) over hashed byte trigrams; the class with most wins, ties by margin, is
taken.  Families are those of ``FAMILIES``; a language that is in none is a
family of its own, so any set of labels works.

The machines learn from a sample with a bound (``A_LANGUAGE`` expected texts of
each language, whole); everything else reads all rows.

Defined results.  Nulls: a text that is null or has no letter is ``und`` with
score 0; a null id counts as the empty text; a null language is not learned
from.  Without any training row all are ``und``.  Ties: of classes with as many
wins and equal margins the first by name; equal texts get equal results.  A very
long text is read whole, its trigrams weigh as shares.  Clashing names: kept
columns stay, an added column of the same name gets an underscore before its
name.  Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, arrow_limits, id_remainder, materialised, named, order_hash, over_batches
from .textscan import Chunk, chunks

FEATURES = 4096
A_LANGUAGE = 400
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur pa mr gu ne",
    "semitic": "ar he mt am",
    "malayic": "id ms jv tl",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "only " + lang)


def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram that begins at each byte, and for each row where its own begin and end."""
    b = _FOLD[chunk.buf]
    if len(b) < 3:
        code = np.zeros(0, np.int64)
    else:
        code = (((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    lo = np.minimum(chunk.offsets[:-1], len(code))
    return code, lo, np.clip(chunk.offsets[1:] - 2, lo, None)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 15) -> np.ndarray:
    """Weights of a linear machine for labels of +1 and -1; the last column of x should be constant."""
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(1)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a trigram's share, so scaled that the median margin is 3; x: shares of the trigrams, a row a text; y: +1 or -1.  The constant is added to each, as the shares of a text add up to 1."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]) + 3.0 * (y[0] if len(y) else 0.0)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    z = np.column_stack((x * scale, np.ones(len(x))))
    z /= np.sqrt((z * z).sum(1).mean())
    w = svm(z, y, c=10.0)
    row = np.append(w[:-1] * scale, w[-1]) * z[0, -1] * (3.0 / max(float(np.median(np.abs(z @ w))), 1e-9))
    return row[:-1] + row[-1]


class Model:
    """names: languages in order; tasks: (level, class, class) of each machine; w: their weights."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.families = sorted({family(n) for n in self.names})
        self.of = [self.families.index(family(n)) for n in self.names]
        self.tasks = [("family", a, b) for a, b in combinations(range(len(self.families)), 2)]
        self.tasks += [("lang", a, b) for a, b in combinations(range(len(self.names)), 2) if self.of[a] == self.of[b]]
        self.w = np.zeros((len(self.tasks), FEATURES), np.float32)

    def side(self, lang: str, task: int) -> int:
        """+1 or -1 for the class of a language in a machine, 0: not in it."""
        level, a, b = self.tasks[task]
        i = self.names.index(lang)
        cls = self.of[i] if level == "family" else i
        return (cls == a) - (cls == b)

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(self.tasks), len(texts)))
        for chunk in chunks(texts):
            code, lo, hi = trigrams(chunk)
            for t in range(len(self.tasks)):
                c = np.concatenate(([0.0], np.cumsum(self.w[t][code], dtype=np.float64)))
                out[t, chunk.first_row : chunk.first_row + chunk.n_rows] = (c[hi] - c[lo]) / np.maximum(hi - lo, 1)
        return out

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence of each row from its margin in each task."""
        n = margins.shape[1]
        sure = 1 / (1 + np.exp(-np.clip(np.abs(margins), 0, 40)))

        def level(name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
            wins, total, conf = np.zeros((size, n)), np.zeros((size, n)), np.ones((size, n))
            for k, (kind, a, b) in enumerate(self.tasks):
                if kind == name:
                    wins[a] += margins[k] >= 0
                    wins[b] += margins[k] < 0
                    total[a] += margins[k]
                    total[b] -= margins[k]
                    for c, sign in ((a, 1), (b, -1)):
                        conf[c] = np.minimum(conf[c], np.where(sign * margins[k] >= 0, sure[k], 1 - sure[k]))
            return wins + 1e-3 * np.tanh(total / 10), conf

        f_rank, f_conf = level("family", len(self.families))
        top = f_rank.argmax(0)
        l_rank, l_conf = level("lang", len(self.names))
        l_rank = np.where(np.array(self.of)[:, None] == top[None, :], l_rank, -np.inf)
        best = l_rank.argmax(0)
        at = np.arange(n)
        return best, f_conf[top, at] * l_conf[best, at]


def fit(docs: DataFrame, a_language: int = A_LANGUAGE) -> Model | None:
    """docs: (text, lang, h) of the training rows, h a hash of the row.  Every machine is fitted by a task of its own, which holds the sampled texts of its two classes; only weights reach the driver."""
    docs = docs.where(F.col("text").rlike("\\p{L}"))
    counts = {r[0]: r[1] for r in docs.groupBy("lang").agg(F.count("*")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, a_language / n))]), F.col("lang"))
    sample = docs.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def work(texts: pa.Array) -> list[pa.Array]:
        out = []
        for chunk in chunks(texts):
            code, lo, hi = trigrams(chunk)
            out += [(np.bincount(code[a:b], minlength=FEATURES) / max(1, b - a)).astype(np.float32).tobytes() for a, b in zip(lo, hi, strict=True)]
        return [pa.array(out, pa.binary())]

    rows = materialised(over_batches(sample, ["lang", "h"], [F.col("text")], work, "x binary"))
    model = Model(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    if not model.names:
        return None
    # each text goes to the machines of its language, a family's machines taking about a_language texts of the family
    per_family = Counter(family(n) for n in model.names)
    tasks = [(n, t, 1 / per_family[family(n)] if level == "family" else 1.0, model.side(n, t)) for n in model.names for t, (level, *_) in enumerate(model.tasks) if model.side(n, t)]
    wanted = docs.sparkSession.createDataFrame(tasks, "lang string, task int, share double, y int")
    dealt = rows.join(F.broadcast(wanted), "lang").where(F.pmod(order_hash("h", seed="family"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def machine(key: tuple, table: pa.Table) -> pa.Table:
        some = sorted(zip(table["y"].to_pylist(), table["x"].to_pylist(), strict=True))
        y = np.array([a for a, _ in some], float)
        x = np.array([np.frombuffer(b, np.float32) for _, b in some], np.float64)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([fitted(x, y).astype(np.float32).tobytes()], pa.binary())})

    done = dealt.select("task", "y", "x").groupBy("task").applyInArrow(machine, "task int, w binary").collect()  # FEATURES numbers a machine
    for task, w in done:
        model.w[task] = np.frombuffer(w, np.float32)
    return model


def identify(docs: DataFrame, training: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row; training: text, lang and h."""
    arrow_limits(docs.sparkSession)
    model = fit(training.where(F.col("lang").isNotNull()))
    text = named(text_col)
    if model is None:
        return docs.select(*map(named, keep), F.lit("und").alias(added(keep, "lang_pred")), F.lit(0.0).alias(added(keep, "score")))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers a machine

    def work(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
        m = sent.value
        best, score = m.predict(m.margins(texts))
        letter = letters.to_numpy(zero_copy_only=False)
        names = np.array(m.names, object)[best]
        names[~letter] = "und"
        return [pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))]

    return over_batches(docs, keep, [text, F.coalesce(text.rlike("\\p{L}"), F.lit(False))], work, "lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    training = slim.where(~F.col("held_out")).select("text", "lang", order_hash("doc_id", seed="langid").alias("h"))
    return identify(slim, training, keep=("doc_id", "held_out"))
