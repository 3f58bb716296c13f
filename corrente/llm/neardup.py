"""Near-duplicate detection by ProbMinHash.

A text is a bag of five-word shingles (words are runs of letters, digits and
non-ASCII characters, A-Z lower-cased) whose weight is 1 + ln(count).  Each
shingle is a Poisson process of rate its weight; every arrival falls into one of
the registers, a register keeps its first arrival, and a process ends once its
time exceeds every register.  Two texts agree in a register with the probability
Jaccard similarity of their bags.  Bands of registers make buckets; texts that
share a bucket are compared with the bucket's pivot, not with each other, by a
byte of each register first, and a link counts only if the exact similarity is
``SIMILARITY`` or more.

Equal texts (in words) are one entry from the start.  The pivot of a bucket
differs by band, so two similar texts meet through many.  Afterwards every
bucket that still holds several classes gets new pivots, round after round,
until a round joins next to none; a link that joins two joins them as wholes.  In
the buckets that hold several classes then, all pairs of different classes are
tested: at once in those of up to ``PAIRED`` entries.  Larger ones are split by
prefix filtering first: if two bags are as similar as that, what they share
weighs that share of each, so the rarest shingle that they share stands among
the rarest of each, before the last ``SIMILARITY`` of its weight.  Only entries
that have such a shingle in common are tested, as pairs if they are few, else by
tasks that hold the bags of two blocks of entries; groups of many entries that
overlap are joined first where that leaves fewer pairs.
Classes are the connected components of the links, found by label propagation
with pointer jumping: in one task up to ``LOCAL_LINKS`` links, beyond that over
all tasks and checkpoints, with the same result.

The size of bands makes a pair of similarity 0.8 share none with probability
6e-5.  Entries go by 64-bit hashes of their words; where those of two texts that
differ agree, which a second hash tells, they get others.

Defined results.  Nulls: a text that is null or has no words is never a
duplicate and is a class of its own.  A null id is the smallest.  A text of fewer
than five words is one shingle.  A very long text is one bag, whole.  Repeated
rows are copies of each other; of those equal in id and text any one stays.
Ties: the smallest id represents a class, of equal ids the smaller hash of id
and text.  Clashing names: own columns stay, ``classes`` has its own alone.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, freed, give_back, materialised, named, order_hash, over_batches, row_key, unused, within, without
from .textscan import WORD, Chunk, chunks, counted, mix64, ngrams, row_digest, signed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
_SECOND = np.uint64(0xA0761D6478BD642F)
#: Registers kept as a byte each tell pairs that cannot be similar enough: at 0.8 less than this share agrees with probability 1e-7.
LEAST_AGREEMENT = 0.65
#: Pairs of two classes that are tested first, before all others whose classes still differ; up to FEW_PAIRS in all are tested at once.
FIRST_PAIRS, FEW_PAIRS = 4, 20_000
#: Rows of a few numbers that one task takes; a bag counts as so many of them.
ROWS_A_TASK, ROWS_A_BAG = 50_000, 20
#: Links up to this number are joined into classes by one task (16 bytes each), more by all.
LOCAL_LINKS = 1_000_000
#: Ids of texts to compare up to this number are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Share of the mixed buckets; rounds that join fewer classes than this end them, as testing all that is left costs less.
FEW_JOINS = 0.01
#: Entries of a bucket up to which its last pairs are rows; beyond, blocks of BLOCK entries on average are compared as wholes.
PAIRED, BLOCK = 32, 1000
#: In the comparison of blocks, shingles of less than one in so many entries are added pair by pair; numbers that one step of it takes.
FEW_OF, PAIRS_AT_ONCE = 16, 1 << 20


def shingles(chunk: Chunk, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two digests of each row's words (0: none), the first of so many bits, and row, hash and count of its shingles."""
    s, e, off = chunk.words(WORD)
    h = chunk.hashes(s, e)
    g, r = ngrams(h, off, SHINGLE, whole_short=True)
    digest = row_digest(h, off)
    if bits < 64:
        digest = np.where(digest != 0, digest >> np.uint64(64 - bits) | np.uint64(1), digest)
    return digest, row_digest(mix64(h ^ _SECOND), off), *counted(r, g)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def prob_minhash(rows: np.ndarray, keys: np.ndarray, w: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m): the element whose process came first in each register; rows ascending."""
    first, holder = np.full((n_rows, m), np.inf), np.zeros((n_rows, m), np.uint64)
    flat_first, flat_holder = first.reshape(-1), holder.reshape(-1)
    latest = np.full(n_rows, np.inf)
    per_row = np.bincount(rows, minlength=n_rows)
    alone = per_row[rows] == 1
    holder[rows[alone]] = keys[alone, None]
    rows, keys, w = rows[~alone], keys[~alone], w[~alone]
    time, step = np.zeros(len(rows)), 0
    while len(rows):
        step += 1
        u = mix64(keys + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        on = time < latest[rows]
        rows, keys, w, time, u = rows[on], keys[on], w[on], time[on], u[on]
        if not len(rows):
            break
        at = rows * m + (mix64(u) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat_first, at, time)
        won = flat_first[at] == time
        flat_holder[at[won]] = keys[won]
        live = rows[np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))]
        latest[live] = first[live].max(1)
    return holder


def band_keys(holder: np.ndarray) -> np.ndarray:
    n, x = len(holder), holder.reshape(len(holder), BANDS, ROWS)
    out = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS)).copy()
    for i in range(ROWS):
        out = mix64(out + x[:, :, i])
    return out


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Exact: the sum over common elements d of 1 / sum over all d' of max(wa'/wa, wb'/wb); keys ascending and distinct."""
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    if not both.any():
        return 0.0
    a, b = wa[both], wb[at[both]]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    t = a / b
    order = np.argsort(t)
    t, a, b = t[order], a[order], b[order]
    from_b, from_a = np.append(0.0, np.cumsum(b)), a.sum() - np.append(0.0, np.cumsum(a))
    lower = np.searchsorted(t, t, "left")
    return float((a / (only_a + from_a[lower] + t * (only_b + from_b[lower]))).sum())


def signatures(docs: DataFrame, text: Column, keep: list[str], bits: int = 64) -> DataFrame:
    """The ``keep`` columns, k and k2 (digests of the words; k null without words), the band keys and a byte of each register."""

    def work(texts: pa.Array) -> list[pa.Array]:
        first, second, bands, sizes, bytes_of = [], [], [], [], []
        for chunk in chunks(texts):
            digest, other, rows, keys, counts = shingles(chunk, bits)
            first.append(digest)
            second.append(other)
            some = digest != 0
            holder = prob_minhash(rows, keys, weights(counts), chunk.n_rows, BANDS * ROWS)
            bands.append(band_keys(holder)[some].reshape(-1))
            small = (mix64(holder) >> np.uint64(56)).astype(np.uint8)
            bytes_of += [x.tobytes() if y else None for x, y in zip(small, some.tolist(), strict=True)]
            sizes.append(np.where(some, BANDS, 0))
        none = np.zeros(0, np.uint64)
        digest = np.concatenate(first or [none])
        off = np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(signed(np.concatenate(bands or [none]))))
        return [pa.array(signed(digest), mask=digest == 0), pa.array(signed(np.concatenate(second or [none]))), lists, pa.array(bytes_of, pa.binary())]

    return over_batches(docs, keep, [text], work, "k long, k2 long, bands array<long>, sig binary")


def bags(docs: DataFrame, text: Column, bits: int = 64) -> DataFrame:
    """(k, k2, bag): the shingles of every text with words, as bytes: sorted hashes, then counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                digest, other, rows, keys, counts = shingles(chunk, bits)
                counts = counts.astype(np.uint32)
                cut = np.searchsorted(rows, np.arange(chunk.n_rows + 1))
                some = np.flatnonzero(digest)
                blobs = [keys[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(cut[some], cut[some + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(digest[some])), pa.array(signed(other[some])), pa.array(blobs, pa.binary())], names=["k", "k2", "bag"])
        give_back()

    return docs.select(text.alias("text")).mapInArrow(work, "k long, k2 long, bag binary")


def told_apart(df: DataFrame, clash: DataFrame | None) -> DataFrame:
    """Another k where that of several texts is the same."""
    if clash is None:
        return df
    both = df.join(clash.withColumn("shared", F.lit(True)), "k", "left")
    return both.withColumn("k", F.when(F.col("shared"), F.xxhash64("k", "k2")).otherwise(F.col("k"))).select(*df.columns)


BAG_BYTES = 12


def opened_bag(x: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights."""
    n = len(x) // BAG_BYTES
    return np.frombuffer(x, np.uint64, n), weights(np.frombuffer(x, np.uint32, n, 8 * n))


def agreeing(pairs: DataFrame, sigs: DataFrame, count: int) -> DataFrame:
    """Those (k, p) in which enough registers agree; count: of the pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["k", "p"]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT if batch.num_rows else np.zeros(0, bool)))

    both = pairs.select("k", "p").join(sigs, "k").join(sigs.toDF("p", "sig_p"), "p")
    return packed(both.select("k", "p", "sig", "sig_p"), count).mapInArrow(work, "k long, p long")


def verified(pairs: DataFrame, held: DataFrame, count: int) -> DataFrame:
    """Those (k, p) whose exact similarity is high enough; count: of the pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            last, right = None, None
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                y = y.as_buffer()
                if last is None or y != last:
                    last, right = y, opened_bag(y)
                ok[i] = probability_jaccard(*opened_bag(x.as_buffer()), *right) >= SIMILARITY - 1e-9
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["k", "p"]).filter(pa.array(ok))
        give_back()

    few = count <= BROADCAST_IDS

    def bags_of(end: str) -> DataFrame:
        """Only the bags that are compared travel."""
        return held.join(F.broadcast(pairs.select(F.col(end).alias("k")).distinct()), "k", "left_semi") if few else held

    with_k = pairs.join(bags_of("k"), "k")
    both = with_k.withColumnRenamed("bag", "bag_k").join(bags_of("p").toDF("p", "bag_p"), "p")
    return packed(both.select("k", "p", "bag_k", "bag_p"), ROWS_A_BAG * count).mapInArrow(work, "k long, p long")


def shared_weight(row: np.ndarray, at: np.ndarray, w: np.ndarray, n: int, cut: int) -> np.ndarray:
    """(n, n): the weight in x of the shingles that x and y share, for rows x and y on either side of ``cut`` (0: for all); at: the shingles as places in a vocabulary.

    A shingle of many rows is a column of a matrix product, one of few adds to its pairs.
    """
    out = np.zeros((n, n))
    order = np.argsort(at, kind="stable")
    row, w, count = row[order], w[order], np.bincount(at)
    start, dense = np.cumsum(count) - count, count * FEW_OF > n
    for c in np.unique(count[~dense & (count > 1)]).tolist():
        columns, step = start[count == c], max(1, PAIRS_AT_ONCE // c**2)
        for i in range(0, len(columns), step):
            place = columns[i : i + step, None] + np.arange(c)
            x = row[place]
            np.add.at(out.reshape(-1), (x[:, :, None] * n + x[:, None, :]).reshape(-1), np.repeat(w[place].reshape(-1), c))
    columns, step = np.flatnonzero(dense & (count > 1)), max(1, PAIRS_AT_ONCE // n)
    for i in range(0, len(columns), step):
        some = columns[i : i + step]
        place = np.repeat(start[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())
        weight = np.zeros((n, len(some)))
        weight[row[place], np.repeat(np.arange(len(some)), count[some])] = w[place]
        has = (weight > 0).astype(float)
        if cut:
            out[:cut, cut:] += weight[:cut] @ has[cut:].T
            out[cut:, :cut] += weight[cut:] @ has[:cut].T
        else:
            out += weight @ has.T
    return out


def _similar_across(key: tuple, table: pa.Table) -> pa.Table:
    """(k, p): links that join all classes of the rows (own, c, bag) that similar pairs join, of own block i and j (in the key) if these differ."""
    i, j = key[1].as_py(), key[2].as_py()
    own = table["own"].to_numpy()
    order = np.argsort(own != i, kind="stable")
    cut = int((own == i).sum()) if i != j else 0
    bag = [x.as_buffer() for x in table["bag"].take(pa.array(order)).combine_chunks()]
    names, root = np.unique(table["c"].to_numpy()[order], return_inverse=True)
    n = np.array([len(x) // BAG_BYTES for x in bag])
    keys, w = zip(*map(opened_bag, bag), strict=True)
    flat, row = np.concatenate(w), np.repeat(np.arange(len(n)), n)
    total = np.bincount(row, flat)
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    # with the shares p and q of the two weights that are in common the similarity is 1 / (1 / p + 1 / q - 1) at most: max(wa'/wa, wb'/wb) is wa'/wa at least, and
    # wb'/wb where only b has d', and the sum over d of 1 / (1 / x + r / y) is not above the same of the sums of x and of y
    with np.errstate(divide="ignore"):
        inverse = total[:, None] / shared_weight(row, at, flat, len(n), cut)
    near, found = inverse + inverse.T <= 1 + 1 / SIMILARITY + 1e-6, []
    for x in range(cut or len(n)):
        for y in (np.flatnonzero(near[x, cut or x + 1 :] & (root[cut or x + 1 :] != root[x])) + (cut or x + 1)).tolist():
            if root[x] != root[y] and probability_jaccard(keys[x], w[x], keys[y], w[y]) >= SIMILARITY - 1e-9:
                found.append((names[root[x]], names[root[y]]))
                root[root == root[y]] = root[x]
    ends = np.array(found, np.int64).reshape(-1, 2)
    give_back()
    return pa.table({"k": ends[:, 0], "p": ends[:, 1]})


def families(rows: DataFrame) -> DataFrame:
    """(b, k): groups in which all pairs meet that meet in a group of the rows (b, k, m), m the size of b's.  Groups that overlap, directly or through others, become one where that is no more pairs, so that two entries do not meet again for each shingle they share."""

    def small(df: DataFrame) -> DataFrame:
        df = materialised(df)
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    least = small(rows.groupBy("b").agg(F.min("k").alias("p"), F.first("m").cast("double").alias("m")))
    family = components(materialised(rows.select("b", "k").join(least, "b").select("k", "p").distinct())).toDF("k", "family")
    apart = least.join(family.toDF("p", "family"), "p").groupBy("family").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    whole = small(family.groupBy("family").agg(F.count("*").cast("double").alias("m")).join(apart, "family").select("family", (F.col("m") * F.col("m") <= F.col("apart")).alias("whole")))
    both = rows.select("b", "k").join(family, "k").join(whole, "family")
    return materialised(both.select(F.when(F.col("whole"), F.col("family")).otherwise(F.col("b")).alias("b"), "k").distinct())


def _least_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, c) of the edges (k, p) of one task."""
    ends = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    if not ends:
        return
    ids, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        if (low == root[x]).all() and (low == root[y]).all():
            break
        # the roots take the smaller label too, so whole trees move at once
        for side in (x, y):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["k", "c"])


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(k, c) of every end of the edges (k, p): the smallest id of its component.  Up to ``local`` edges (16 bytes each) are joined by one task, more by rounds of propagation over all tasks."""
    if edges.count() <= local:
        return materialised(edges.select("k", "p").coalesce(1).mapInArrow(_least_members, "k long, c long"))
    two = materialised(edges.select("k", "p").unionByName(edges.select(F.col("p").alias("k"), F.col("k").alias("p"))).distinct())
    label = materialised(two.groupBy("k").agg(F.min("p").alias("c")).select("k", F.least("k", "c").alias("c")))
    while True:
        near = two.join(label.toDF("p", "d"), "p").groupBy("k").agg(F.min("d").alias("d"))
        low = label.join(near, "k").select("k", F.least("c", "d").alias("c"), F.col("c").alias("old"))
        jumped = materialised(low.join(low.select(F.col("k").alias("c"), F.col("c").alias("d")), "c").select("k", F.least("c", "d").alias("c"), "old"))
        label = jumped.select("k", "c")
        if jumped.where("c <> old").isEmpty():
            return label


def packed(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` slim rows in as many tasks as they need: small rounds write few files and call Python few times, large ones lose no parallelism."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def rare_prefixes(entries: DataFrame, held: DataFrame) -> DataFrame:
    """(k, b): for every entry k those of its shingles, as b, that come first by rarity among the entries, before the last ``SIMILARITY`` of its weight, and that another entry has too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, bag in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, w = opened_bag(bag.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(signed(h)), pa.array(w)], names=["k", "b", "w"])

    every = entries.join(held, "k").select("k", "bag").mapInArrow(spread, "k long, b long, w double")
    met = materialised(every.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"))
    met = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
    by_rarity = Window.partitionBy("k").orderBy(F.coalesce("n", F.lit(1)), "b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = every.join(met, "b", "left").withColumn("before", F.coalesce(F.sum("w").over(by_rarity), F.lit(0.0))).withColumn("total", F.sum("w").over(Window.partitionBy("k")))
    return ranked.where((F.col("total") - F.col("before") >= SIMILARITY * (1 - 1e-9) * F.col("total")) & (F.col("n") > 1)).select("k", "b")


def links(docs: DataFrame, entries: DataFrame, text: Column, clash: DataFrame | None = None, bits: int = 64) -> DataFrame | None:
    """(k, c): the class of every entry that is linked to another; entries: (k, bands, sig), once each.  None: no bucket holds two."""
    spread = entries.select("k", F.explode("bands").alias("b"))
    # xor with the bucket orders its entries, differently in each bucket, and gives them back
    shared = materialised(spread.groupBy("b").agg(F.min(F.col("k").bitwiseXOR(F.col("b"))).alias("lo"), F.max(F.col("k").bitwiseXOR(F.col("b"))).alias("hi")).where("lo <> hi").select("b", F.col("lo").bitwiseXOR(F.col("b")).alias("p")))
    if shared.isEmpty():
        return None
    member = materialised(spread.join(shared, "b"))
    size = member.count()
    member = packed(member, size)
    needed = materialised(packed(member.select("k").distinct(), size))
    count = needed.count()
    of_needed = F.broadcast(needed) if count <= BROADCAST_IDS else needed
    held = packed(materialised(told_apart(bags(docs, text, bits), clash).join(of_needed, "k", "left_semi").select("k", "bag").dropDuplicates(["k"])), ROWS_A_BAG * count)
    sigs = packed(materialised(entries.select("k", "sig").join(of_needed, "k", "left_semi")), size)

    def tested(pairs: DataFrame) -> DataFrame:
        near = materialised(agreeing(pairs, sigs, pairs.count()))
        count = near.count()
        return packed(materialised(verified(near, held, count)), count)

    def grown(label: DataFrame, new: DataFrame) -> DataFrame:
        """Labels after links of classes, which join as wholes."""
        into = components(new)
        out = label.join(into.toDF("c", "c2"), "c", "left").select("k", F.coalesce("c2", "c").alias("c"))
        return materialised(packed(out.unionByName(into.join(label, "k", "left_anti")), size))

    def exhausted(label: DataFrame, now: DataFrame, done: DataFrame) -> DataFrame:
        """Labels after the test of all pairs of different classes in the buckets of now: (k, b, c)."""
        sizes = materialised(packed(now.groupBy("b").agg(F.count("*").alias("m")).where("m > 2"), size))  # of two, one was the pivot
        rows = materialised(packed(now.join(sizes, "b"), size))
        label = paired(label, rows.where(F.col("m") <= PAIRED), done)
        large = rows.where(F.col("m") > PAIRED).select("k").distinct()
        if large.isEmpty():
            return label
        split = classed(materialised(rare_prefixes(large, held)), label)
        # shingles that the same entries share are one
        alike = [F.bit_xor(order_hash("k", seed=x)).alias(x) for x in ("one", "two")]
        mixed = split.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), *alike).where("lo <> hi").groupBy("m", "one", "two").agg(F.min("b").alias("b")).select("b", "m")
        rows = materialised(split.join(materialised(mixed), "b"))
        label = paired(label, rows.where(F.col("m") <= PAIRED), done)
        large = rows.where(F.col("m") > PAIRED).select("b", "k", "m")
        if large.isEmpty():
            return label
        large = families(large)
        blocks = large.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
        large = classed(large.join(blocks, "b"), label).select("b", "k", "c", "g")
        large = large.withColumn("own", F.pmod(order_hash("k", seed="block"), F.col("g")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
        large = large.select("b", "k", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        new = large.join(held, "k").select("b", "i", "j", "own", "c", "bag").groupBy("b", "i", "j").applyInArrow(_similar_across, "k long, p long")
        new = materialised(new.distinct())
        return label if new.isEmpty() else grown(label, new)

    def classed(rows: DataFrame, label: DataFrame) -> DataFrame:
        """Entries without a link are a class each."""
        return rows.join(label, "k", "left").withColumn("c", F.coalesce("c", "k"))

    def paired(label: DataFrame, rows: DataFrame, done: DataFrame) -> DataFrame:
        """Labels after the test of all pairs of rows (b, k, c) of one b and different classes."""
        small = rows.select("b", "k", "c")
        both = small.join(small.toDF("b", "p", "d"), "b").where("k < p AND c <> d")
        return settled(label, materialised(both.select("k", "p").distinct().join(done, ["k", "p"], "left_anti")))[0]

    def settled(label: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Labels after the test of all pairs (k, p) of different classes, and how many links joined some.  Of two classes only some pairs are tested at once, as one link makes the others needless."""
        joined = 0
        for most in (FIRST_PAIRS, None):
            apart = pairs.join(label.toDF("k", "ck"), "k", "left").join(label.toDF("p", "cp"), "p", "left")
            apart = apart.select("k", "p", F.coalesce("ck", "k").alias("ck"), F.coalesce("cp", "p").alias("cp")).where("ck <> cp")
            apart = materialised(packed(apart, size))
            count = apart.count()
            if not count:
                break
            every = most is None or count <= FEW_PAIRS
            # the least of each of some orders
            picks = [F.min(F.struct(order_hash("k", "p", seed=f"pair {i}").alias("h"), "k", "p", "ck", "cp")).alias(f"x{i}") for i in range(most or 0)]
            chosen = apart if every else materialised(apart.groupBy(F.least("ck", "cp").alias("lo"), F.greatest("ck", "cp").alias("hi")).agg(*picks).select(F.explode(F.array(*[f"x{i}" for i in range(len(picks))])).alias("x")).select("x.k", "x.p", "x.ck", "x.cp").distinct())
            new = tested(chosen).join(chosen, ["k", "p"]).select(F.col("ck").alias("k"), F.col("cp").alias("p"))
            new = materialised(packed(new, count))
            met = new.count()
            if met:
                label, joined = grown(label, new), joined + met
            if every:
                break
            pairs = apart.select("k", "p").join(chosen.select("k", "p"), ["k", "p"], "left_anti")
        return label, joined

    pairs = member.where("k <> p").groupBy("k", "p").agg(F.count("*").alias("n"))
    ranked = materialised(packed(pairs.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "p"))), size))
    # first every entry with the pivot that it meets most often, then the other pivots where these are of another class yet
    label = components(tested(ranked.where("at = 1")))
    label, _ = settled(label, ranked.where("at > 1").select("k", "p"))
    either_way = [F.least("k", "p").alias("k"), F.greatest("k", "p").alias("p")]
    done, member, turn = materialised(packed(ranked.select(*either_way).distinct(), size)), member.select("k", "b"), 0
    while True:
        turn += 1
        now = classed(member, label).select("k", "b", "c")
        pick = F.min(F.struct(order_hash("k", "b", seed=f"turn {turn}").alias("h"), "k", "c"))
        mixed = now.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pick.alias("x")).where("lo <> hi").select("b", F.col("x.k").alias("p"), F.col("x.c").alias("d"))
        # only the buckets of several classes go on
        mixed = materialised(packed(mixed, size))
        now = materialised(packed(now.join(mixed, "b"), size))
        more = materialised(packed(now.where("c <> d").select(*either_way).distinct().join(done, ["k", "p"], "left_anti"), size))
        label, joined = settled(label, more)
        if joined <= FEW_JOINS * mixed.count():
            return exhausted(label, now, done.unionByName(more))
        done = materialised(packed(done.unionByName(more), size))
        member = now.select("k", "b")


def classes(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", bits: int = 64) -> DataFrame:
    """Id, a and b (the key of id and text), class_id (smallest id of the class), class_size and kept (of the rows of a class those that equal its first in id and text) of every row.  bits: of the hashes that entries go by."""
    arrow_limits(docs.sparkSession)
    text = named(text_col)
    a, b = row_key(named(id_col), text)
    ident = docs.select(named(id_col).alias("id"), a.alias("a"), b.alias("b"), text.alias("text"))
    rows = materialised(signatures(ident, F.col("text"), ["id", "a", "b"], bits))
    clash = materialised(rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo <> hi").select("k"))
    clash = None if clash.isEmpty() else clash
    freed(docs.sparkSession)
    rows = told_apart(rows, clash)
    some = rows.where(F.col("k").isNotNull())
    least = materialised(some.groupBy("k").agg(F.min(F.struct("id", "a", "b")).alias("rep"), F.count("*").alias("n")))
    linked = links(docs, materialised(some.select("k", "bands", "sig").dropDuplicates(["k"])), text, clash, bits)
    freed(docs.sparkSession)  # the rounds leave plans behind, too
    if linked is None:
        table = least
    else:
        known = least.join(linked, "k")
        of = known.groupBy("c").agg(F.min("rep").alias("rep2"), F.sum("n").alias("n2"))
        both = linked.join(of, "c").select("k", "rep2", "n2")
        table = least.join(both, "k", "left").select("k", F.coalesce("rep2", "rep").alias("rep"), F.coalesce("n2", "n").alias("n"))
    out = rows.select("id", "a", "b", "k").join(materialised(table), "k", "left")
    first: Column = F.col("k").isNull() | (F.col("a").eqNullSafe(F.col("rep.a")) & F.col("b").eqNullSafe(F.col("rep.b")))
    return out.select("id", "a", "b", F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), first.alias("kept"), F.col("k").isNull().alias("wordless"))


def deduplicated(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each class, with all columns.  Only keys of the rows that go travel."""
    keys = row_key(named(id_col), named(text_col))
    found = materialised(classes(docs, text_col=text_col, id_col=id_col).select("a", "b", "kept", "wordless"))
    stay = without(docs, found.where(~F.col("kept")).select("a", "b"), keys)
    # rows of one id and text all equal their first
    again = materialised(found.where(F.col("kept") & ~F.col("wordless")).groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"))
    if again.isEmpty():
        return stay
    names = [unused(docs, x) for x in ("key_of_row", "key_of_row_too")]
    once = within(stay, again, keys).select("*", *[c.alias(n) for c, n in zip(keys, names, strict=True)]).dropDuplicates(names)
    return without(stay, again, keys).unionByName(once.select(*[named(c) for c in docs.columns]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and kept of every document."""
    out = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
