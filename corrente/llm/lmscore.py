"""Language-model scores from a log-frequency Bloom filter.

The filter holds unigrams and bigrams of the training documents with their
counts on a log scale: an n-gram of count c is entered at levels 1 to
1 + floor(log2 c), and a probe asks level after level until one is missing.
n-grams are dealt out to shards by their hashes; every shard is a stretch of
64-bit words of the filter, in which the bits of an n-gram at a level share one
word.  The filter's size follows the number of n-grams without a bound.  Up to
``MAX_FILTER_BYTES`` it is broadcast whole to the workers.  A larger one cannot
be, so the probes travel: the distinct n-grams of a batch of texts go to their
shards, and their levels come back to the texts.  The bits and the answers are
the same either way.

All counts of the score come from the filter.  A token's probability is the
bigram estimate after absolute discounting, (c(h, w) - D) / c(h), and the mass
so taken from histories of h's level times the unigram estimate,
(c(w) + 1) / (N + V + 1).  D for count 1 and for more follows from the numbers of
bigrams of count 1, 2 and 3.  So the score depends on how many tokens of a text
have each combination of levels (of the word, its history and the pair); texts
are read once for these numbers, and the scores follow from them.

The base score needs exact counts: those of the most frequent tokens, ``HEAD`` of
them at most, are broadcast, all others are joined by hash.

n-grams travel as blocks of 32-bit keys, a row a batch and shard, and shards grow
in number with the input, so no shard outgrows a task.  Two n-grams of a shard
share a key with a probability far below the filter's own error rate.

Defined results.  Nulls: a null text is empty and has the end token alone; a null
id counts as the empty text.  Ties do not arise: every row is scored by itself,
equal rows alike.  A very long text is one row of a batch, read whole.  Clashing
names: only id and text are read, other columns are ignored.  An empty table
gives an empty result; without training rows every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, freed, id_remainder, materialised
from .textscan import NONBLANK, Chunk, chunks, mix64, row_of, signed

HEAD = 1 << 18
MAX_FILTER_BYTES = 8 << 20
FIRST_BITS, MORE_BITS = 7, 4
WORDS_A_KEY = 14 / 64  # 14 bits an entry at any level
SHARDS_A_PARTITION = 4
#: Bytes of text whose n-grams travel together, to be counted and to be looked up, and keys that are looked up at once.
COUNTED_BYTES, BATCH_BYTES, KEYS_AT_ONCE = 8 << 20, 4 << 20, 1 << 19
_LEVELS = 34
_END = np.uint64(0x5BD1E9955BD1E995)
_UNIGRAM = np.uint64(0x1F83D9ABFB41BD6B)
_LAST = np.uint64(1)


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, an end after the words of each row, and where each row's tokens begin."""
    s, e, off = chunk.words(NONBLANK)
    h = chunk.hashes(s, e)
    out = np.full(len(h) + chunk.n_rows, _END, np.uint64)
    out[np.arange(len(h)) + row_of(off)] = h
    return out, off + np.arange(chunk.n_rows + 1)


def all_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of whole arrays, a chunk after the other."""
    h, off, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for c in chunks(texts):
        x, at = tokens(c)
        h.append(x)
        off.append(at[1:] + total)
        total += len(x)
    return np.concatenate(h), np.concatenate(off)


def pairs(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; an end stands before the first."""
    before = np.empty_like(h)
    if len(h):
        before[1:] = h[:-1]
        before[off[:-1]] = _END
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + h)


def unigram_keys(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ _UNIGRAM)


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("text")


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of every training token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [tokens(c)[0] for c in chunks(batch.column(0))]
            if every:
                h, n = np.unique(np.concatenate(every), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "c"])

    return _training(docs).mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> DataFrame:
    """The most frequent tokens: as many of the highest counts as give ``HEAD`` rows at most."""
    size = F.when(F.col("c") < 1 << 12, F.col("c")).otherwise(F.lit(1 << 12) * F.floor(F.col("c") / (1 << 12)))
    found = sorted(map(tuple, counts.where(F.col("c") < 1 << 24).groupBy(size.alias("at")).agg(F.count("*")).collect()), reverse=True)  # some 8000 rows at most
    least, total = 1 << 24, counts.where(F.col("c") >= 1 << 24).count()
    for at, n in found:
        total += n
        if total > HEAD:
            break
        least = at
    return counts.where(F.col("c") >= least).select("h", "c")


def located(words: np.ndarray, pair: np.ndarray, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32-bit key of words, then of pairs; the last bit of a key tells them apart."""
    keys = np.concatenate((unigram_keys(words), pair))
    shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
    rest = ((keys << np.uint64(shard_bits)) >> np.uint64(32)) & ~_LAST
    rest[len(words) :] |= _LAST
    return shard, rest.astype(np.uint32)


def _order(shard: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """By shard, then by key."""
    return np.argsort(shard.astype(np.uint64) << np.uint64(32) | rest)


def _blocks(shard: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Each shard and its part of the keys (as their steps) and of the columns, as bytes: first bytes before second ones and so on, which compresses well.  Rows in ``_order``."""
    ids, first = np.unique(shard, return_index=True)
    cut = np.append(first, len(shard))
    split = lambda x: np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    steps = lambda x: np.diff(x, prepend=np.uint32(0))
    parts = [(keys, steps), *((c, lambda x: x) for c in columns)]
    return ids.astype(np.int32), [pa.array([split(f(x[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x, f in parts]


def _joined(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in blocks] or [np.zeros(0, np.uint32)])


def _keys(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.cumsum(_joined([x]), dtype=np.uint32) for x in blocks] or [np.zeros(0, np.uint32)])


def filter_shards(docs: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, words, ones, twos, threes): the filter's stretch of each shard, and how many of its pairs occur once, twice and three times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0), COUNTED_BYTES):
                h, off = all_tokens(batch.column(0).slice(part.first_row, part.n_rows))
                (words, nw), (pair, n) = np.unique(h, return_counts=True), np.unique(pairs(h, off), return_counts=True)
                shard, rest = located(words, pair, shard_bits)
                order = _order(shard, rest)
                ids, blobs = _blocks(shard[order], rest[order], np.concatenate((nw, n)).astype(np.uint32)[order])
                yield pa.RecordBatch.from_arrays([pa.array(ids), *blobs], names=["shard", "keys", "n"])

    kind = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64()), ("threes", pa.int64())])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rest, n = _keys(table["keys"].to_pylist()), _joined(table["n"].to_pylist())
        order = np.argsort(rest)
        rest, n = rest[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        n, rest = np.add.reduceat(n, first), rest[first].astype(np.uint64)
        of_pairs = n[(rest & _LAST) == 1]
        words = stretch(rest, n, int(np.ceil(_levels(n).sum() * WORDS_A_KEY)) + 1)
        return pa.table([[key[0].as_py()], [words.tobytes()], *[[int((of_pairs == c).sum())] for c in (1, 2, 3)]], schema=kind)

    return _training(docs).mapInArrow(work, "shard int, keys binary, n binary").groupBy("shard").applyInArrow(merge, "shard int, words binary, ones long, twos long, threes long")


def _levels(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1


def place(rest: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of keys at a level."""
    x = mix64(rest + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    word = ((x >> np.uint64(32)) * size) >> np.uint64(32)
    y = mix64(x)
    bits = np.zeros(len(x), np.uint64)
    for i in range(FIRST_BITS if level == 1 else MORE_BITS):
        bits |= np.uint64(1) << ((y >> np.uint64(6 * i)) & np.uint64(63))
    return word, bits


def stretch(rest: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The words of a shard that holds keys of these counts."""
    words, level = np.zeros(size, np.uint64), _levels(n)
    for at in range(1, int(level.max(initial=0)) + 1):
        w, bits = place(rest[level >= at], at, np.uint64(size))
        np.bitwise_or.at(words, w.astype(np.int64), bits)
    return words


class Filter:
    """Stretches of some shards, one after the other; offset, size: of each shard's, in words."""

    def __init__(self, shard_bits: int, stretches: dict[int, np.ndarray]):
        self.size = np.array([len(stretches.get(s, ())) for s in range(1 << shard_bits)], np.uint64)
        self.offset = np.concatenate(([0], np.cumsum(self.size[:-1]))).astype(np.uint64)
        self.words = np.concatenate([stretches[s] for s in sorted(stretches)]) if stretches else np.zeros(0, np.uint64)

    def level(self, shard: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Level of each key, 0 if it is not there."""
        out = np.zeros(len(rest), np.uint8)
        alive = np.flatnonzero(self.size[shard] > 0)
        rest, offset, size = rest[alive].astype(np.uint64), self.offset[shard[alive]], self.size[shard[alive]]
        for at in range(1, _LEVELS):
            if not len(alive):
                break
            w, bits = place(rest, at, size)
            ok = (self.words[(w + offset).astype(np.int64)] & bits) == bits
            alive, rest, offset, size = alive[ok], rest[ok], offset[ok], size[ok]
            out[alive] = at
        return out


def expected(level: np.ndarray) -> np.ndarray:
    """Mean count at a level, as counts thin out like 1 / c."""
    return np.where(level <= 1, level.astype(float), np.exp2(level - 1.0) / np.log(2.0))


class Grams:
    """The distinct n-grams of some texts and where each token's are among them."""

    def __init__(self, texts: pa.Array, shard_bits: int):
        h, self.off = all_tokens(texts)
        self.words, self.word_at = np.unique(h, return_inverse=True)
        pair, self.pair_at = np.unique(pairs(h, self.off), return_inverse=True)
        self.shard, self.rest = located(self.words, pair, shard_bits)
        self.order = _order(self.shard, self.rest)

    def asked(self) -> tuple[np.ndarray, list[pa.Array]]:
        return _blocks(self.shard[self.order], self.rest[self.order])

    def codes(self, levels: np.ndarray, in_order: bool) -> np.ndarray:
        """For each token the levels of the word, its history and the pair as one number; levels: of the n-grams, or as the shards answered."""
        if in_order:
            levels, told = np.zeros(len(self.rest), np.uint8), levels
            levels[self.order] = told
        word = levels[: len(self.words)].astype(np.int64)[self.word_at]
        pair = levels[len(self.words) :].astype(np.int64)[self.pair_at]
        before = np.empty_like(word)
        if len(word):
            before[1:] = word[:-1]
            at = np.searchsorted(self.words, _END)
            before[self.off[:-1]] = levels[at] if at < len(self.words) and self.words[at] == _END else 0
        # a pair cannot be where its parts are not, nor more often
        pair = np.minimum(pair, np.minimum(word, before))
        return (word * _LEVELS + before) * _LEVELS + pair


class Head:
    """Exact counts of the most frequent tokens."""

    def __init__(self, h: np.ndarray, counts: np.ndarray):
        order = np.argsort(h)
        self.h, self.counts = h[order], counts[order]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, 0 for others, and which are frequent."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(known, self.counts[at], 0), known


_READ = "doc_id long, held_out boolean, n_tokens long, known long, base double, codes binary, rare array<long>, rare_n array<int>"
_READ_NAMES = ["doc_id", "held_out", "n_tokens", "known", "base", "codes", "rare", "rare_n"]


def _read(rows: pa.RecordBatch, some: list[tuple[int, Grams, np.ndarray]], head: Head) -> pa.RecordBatch:
    """What the scores need of each text; some: the first row, the n-grams and the codes of the tokens of runs of rows."""
    size, known, base = (np.zeros(rows.num_rows, kind) for kind in (np.int64, np.int64, float))
    codes, rare, times, rare_n = [], [], [], np.zeros(rows.num_rows, np.int64)
    for first, grams, code in some:
        count, frequent = head.look(grams.words)
        n_rows = len(grams.off) - 1
        r, at = row_of(grams.off), slice(first, first + n_rows)
        often = frequent[grams.word_at]
        size[at] = np.diff(grams.off)
        known[at] = np.bincount(r, often, n_rows)
        base[at] = np.bincount(r, np.log10(count + 1.0)[grams.word_at], n_rows)
        seldom, k = np.unique(r[~often] * len(grams.words) + grams.word_at[~often], return_counts=True)
        rare.append(grams.words[seldom % max(1, len(grams.words))])
        times.append(k.astype(np.int32))
        rare_n[at] = np.bincount(seldom // max(1, len(grams.words)), minlength=n_rows)
        both, n = np.unique(r * _LEVELS**3 + code, return_counts=True)
        # in two bytes each; a code of more tokens than these hold comes several times
        more = (n - 1) // 0xFFFF
        both, n = np.repeat(both, more + 1), np.insert(np.full(more.sum(), 0xFFFF), np.cumsum(more), n - more * 0xFFFF)
        cut = np.searchsorted(both, np.arange(n_rows + 1) * _LEVELS**3)
        c, n = (both % _LEVELS**3).astype(np.uint16), n.astype(np.uint16)
        codes += [c[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    cut = pa.array(np.append(0, np.cumsum(rare_n)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (signed(np.concatenate(rare or [np.zeros(0, np.uint64)])), np.concatenate(times or [np.zeros(0, np.int32)]))]
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, (size, known, base)), pa.array(codes, pa.binary()), *lists], names=_READ_NAMES)


def read_with_whole_filter(docs: DataFrame, bloom: Broadcast, head: Broadcast, shard_bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for part in chunks(batch.column(2)):
                grams = Grams(batch.column(2).slice(part.first_row, part.n_rows), shard_bits)
                some.append((part.first_row, grams, grams.codes(bloom.value.level(grams.shard, grams.rest), False)))
            yield _read(batch, some, head.value)

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, _READ)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(batch, body): doc_id, held_out and text of a batch of rows, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in chunks(batch.column(2), BATCH_BYTES):
                sink, rows = pa.BufferOutputStream(), batch.slice(chunk.first_row, chunk.n_rows)
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "body"])
                number += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, "batch long, body binary")


def _opened(body: pa.Buffer, shard_bits: int) -> tuple[pa.RecordBatch, Grams]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    return batch, Grams(batch.column(2), shard_bits)


def read_with_shards(docs: DataFrame, shards: DataFrame, head: Broadcast, shard_bits: int) -> DataFrame:
    """As with the whole filter; the n-grams of each batch of texts are looked up where their shards are."""
    bodies = materialised(packed_texts(docs))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, (keys,) = _opened(body.as_buffer(), shard_bits)[1].asked()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids), keys], names=["batch", "shard", "keys"])

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        bloom = Filter(0, {0: np.frombuffer(held["words"][0].as_py(), np.uint64)} if held.num_rows else {})
        blocks = asked["keys"].to_pylist()
        cut = np.append(0, np.cumsum([len(x) // 4 for x in blocks]))
        keys = _keys(blocks)
        parts = [keys[a : a + KEYS_AT_ONCE] for a in range(0, len(keys), KEYS_AT_ONCE)]
        level = np.concatenate([bloom.level(np.zeros(len(x), np.int64), x) for x in parts] or [np.zeros(0, np.uint8)])
        levels = [level[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"batch": asked["batch"], "shard": asked["shard"], "levels": pa.array(levels, pa.binary())})

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, levels in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, grams = _opened(body.as_buffer(), shard_bits)
                yield _read(rows, [(0, grams, grams.codes(np.frombuffer(b"".join(levels), np.uint8), True))], head.value)

    asked = bodies.mapInArrow(ask, "batch long, shard int, keys binary")
    told = asked.groupBy("shard").cogroup(shards.select("shard", "words").groupBy("shard")).applyInArrow(answer, "batch long, shard int, levels binary")
    told = told.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "levels"))).alias("levels"))
    told = materialised(told.select("batch", F.col("levels.levels").alias("levels")))
    freed(docs.sparkSession)
    return bodies.join(told, "batch").select("body", "levels").mapInArrow(use, _READ)


def discounts(ones: int, twos: int, threes: int) -> tuple[float, float]:
    """What is taken from a pair's count of 1, and of more."""
    y = ones / max(1, ones + 2 * twos)
    once = 1 - 2 * y * twos / max(1, ones)
    more = 2 - 3 * y * threes / max(1, twos)
    return min(max(once, 0.1), 0.95), min(max(more, 0.1), 1.9)


def opened_code(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the word, its history and the pair."""
    return code // _LEVELS**2, code // _LEVELS % _LEVELS, code % _LEVELS


class Model:
    """Probabilities of tokens by their codes.  n, v: training tokens and distinct ones; codes: how many training tokens have each code; d: the discounts."""

    def __init__(self, n: int, v: int, codes: dict[int, int], d: tuple[float, float]):
        code = np.array(sorted(codes), np.int64)
        k = np.array([codes[c] for c in code.tolist()], float)
        _, before, pair = opened_code(code)
        taken = np.where(pair > 0, self.less(pair, d) / np.maximum(expected(pair), 1.0), 1.0)
        mass, every = (np.bincount(before, w, _LEVELS) for w in (k * taken, k))
        # a history never met gives its whole mass to the words; one token stands for levels not met
        self.mass = (mass + 1.0) / (every + 1.0)
        self.mass[0] = 1.0
        self.n, self.v, self.d = n, v, d

    @staticmethod
    def less(pair: np.ndarray, d: tuple[float, float]) -> np.ndarray:
        return np.where(pair <= 1, d[0], d[1])

    def log10(self, code: np.ndarray) -> np.ndarray:
        word, before, pair = opened_code(code)
        one = (expected(word) + 1) / (self.n + self.v + 1)
        two = np.where(pair > 0, np.maximum(expected(pair) - self.less(pair, self.d), 0.0), 0.0) / np.maximum(expected(before), 1.0)
        return np.log10(np.minimum(two + self.mass[before] * one, 1.0))


def _codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.frombuffer(blob, np.uint16).reshape(2, -1).astype(np.int64)
    return c, n


def score_documents(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out).  doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    counts = materialised(token_counts(docs))
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    rows = frequent(counts).collect()  # HEAD at most
    head = spark.sparkContext.broadcast(Head(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)))
    few = len(rows) < v
    del rows
    shard_bits = int(np.ceil(np.log2(max(8, SHARDS_A_PARTITION * docs.rdd.getNumPartitions()))))
    shards = materialised(filter_shards(docs, shard_bits))
    freed(spark)
    size, *pairs_of = (int(x or 0) for x in shards.agg(F.sum(F.octet_length("words")), F.sum("ones"), F.sum("twos"), F.sum("threes")).first())
    if size <= MAX_FILTER_BYTES:
        bloom = Filter(shard_bits, {r[0]: np.frombuffer(r[1], np.uint64) for r in shards.select("shard", "words").collect()})
        read = read_with_whole_filter(docs, spark.sparkContext.broadcast(bloom), head, shard_bits)
    else:
        read = read_with_shards(docs, shards, head, shard_bits)
    read = materialised(read.withColumn("rid", F.monotonically_increasing_id()))
    freed(spark)

    def code_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LEVELS**3, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                c, k = _codes(blob)
                np.add.at(total, c, k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "k"])

    met = read.where("NOT held_out").select("codes").mapInArrow(code_counts, "code long, k long").groupBy("code").agg(F.sum("k")).collect()  # _LEVELS cubed rows at most
    model = spark.sparkContext.broadcast(Model(n, v, dict(map(tuple, met)), discounts(*pairs_of)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value.log10(np.arange(_LEVELS**3))
        for batch in batches:
            out = [float((p[c] * k).sum()) for c, k in map(_codes, batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64()), batch.column(6)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rid"])

    scored = read.select("doc_id", "held_out", "n_tokens", "known", "base", "codes", "rid").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rid long")
    if few:
        rare = read.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("k"))
        tail = rare.join(counts, "h").groupBy("rid").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"))
        scored = scored.join(tail, "rid", "left")
    else:
        scored = scored.withColumn("more_known", F.lit(0)).withColumn("more", F.lit(0.0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score_documents(slim)
