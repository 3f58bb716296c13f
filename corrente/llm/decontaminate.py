"""Benchmark decontamination by a prefix-filtered containment join.

The shingles of an item are its windows of 13 consecutive words (all its words,
if it has fewer).  A text contains a window only if it contains the window's
rarest word, so that word, the rarest by its count over all documents, is the
whole necessary prefix at full containment.  One pass marks the positions where
such a prefix word may stand, through a bitmap of word hashes whose size has a
fixed bound; only these positions, each with the words around it, leave the
text.  An equi-join on the prefix word, the positional bounds (the window must
fit between the ends of the text) and an exact comparison of all words follow.

No text and no pair of texts is shuffled.  Hits of one document come together,
never those of a group of copies; n_hit is the length of the union of intervals.
Beyond ``MAX_BITS`` the bitmap marks more positions in vain, which costs time and
changes no result.

Defined results.  Nulls: a null or wordless text has no words, no hits and is
not contaminated; a null or wordless item has no windows; an item without an id
marks words but is not counted among the items.  Repeated items and rows count
as themselves (item ids once).  Ties: windows that occur at one place all count.
Very long texts are read to the end as one row; what leaves them grows with
their marked positions.  Clashing names: kept columns stay as they are, an added
column of the same name gets an underscore before its name.  Empty tables give
empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import added, materialised, named, row_key, without

WINDOW = 13
#: Windows up to this count are broadcast (about 300 bytes each); more are joined by shuffling.
BROADCAST_WINDOWS = 50_000
#: Distinct words of windows up to this count are broadcast with their counts.
BROADCAST_WORDS = 200_000
BITS_A_WORD, MIN_BITS, MAX_BITS = 256, 1 << 12, 1 << 24
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _raw_words(text: Column) -> Column:
    """The words as written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), lambda w: w != "")


def ascii_lower(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words) of every window of every item."""
    words = F.transform(_raw_words(F.col(text_col)), ascii_lower)
    return (
        items.select(F.col(id_col).cast("string").alias("item"), words.alias("all"))
        .where(F.size("all") > 0)
        .select("item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("i"))
        .select("item", F.slice("all", F.col("i") + 1, F.lit(window)).alias("words"))
    )


def with_prefix(windows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(words, tok, o): each distinct window with its rarest word, by count over all documents, and that word's place."""
    # matched in any case first, as lower() is cheap; exact letters after
    vocabulary = materialised(windows.select(F.explode("words").alias("tok")).select(F.lower("tok").alias("low")).distinct())
    # a common word stands in many windows, so its count is broadcast to them; beyond the bound the join is one of two exchanges, which adaptive execution splits
    send = F.broadcast if vocabulary.count() <= BROADCAST_WORDS else (lambda x: x)
    said = docs.select(F.explode(F.split(text_col, _SEPARATORS)).alias("w")).select(F.lower("w").alias("low"))
    counts = send(materialised(said.join(send(vocabulary), "low", "left_semi").groupBy("low").agg(F.count("*").alias("c"))))
    parts = windows.select("words").distinct().select("words", F.posexplode("words").alias("o", "tok")).withColumn("low", F.lower("tok"))
    ranked = parts.join(counts, "low", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "tok", "o")).alias("best"))
    return ranked.select("words", F.col("best.tok").alias("tok"), F.col("best.o").alias("o"))


def _bitmap(prefixes: DataFrame) -> tuple[list[int], int]:
    """Bits of the hashes of the prefix words, as longs, and the number of bits; never above MAX_BITS, however many the words."""
    low = prefixes.select(F.lower("tok").alias("low")).distinct()
    n, bits = low.count(), MIN_BITS
    while bits < min(MAX_BITS, BITS_A_WORD * n):
        bits *= 2
    at = F.pmod(F.xxhash64("low"), F.lit(bits))
    rows = low.select(at.alias("at")).groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))")).collect()
    cells = [0] * (bits // 64)
    for cell, value in rows:
        cells[cell] = value
    return cells, bits


def _marked(text: Column, bitmap: tuple[list[int], int], window: int) -> Column:
    """n: number of words; at: the marked positions, each with the words around it."""
    cells, bits = bitmap
    # one text literal, which the optimizer folds into an array of longs
    table = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")

    def seen(w: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lower(w)), F.lit(bits))
        return F.when(F.bit_get(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1, i)

    def around(ws: Column, i: Column) -> Column:
        first = F.greatest(i - (window - 1), F.lit(0))
        return F.struct(ascii_lower(F.get(ws, i)).alias("tok"), i.alias("i"), first.alias("first"), F.transform(F.slice(ws, first + 1, F.lit(2 * window - 1)), ascii_lower).alias("near"))

    # a one-element array binds the words, so that the split is done once
    bound = F.transform(F.array(_raw_words(text)), lambda ws: F.struct(F.size(ws).alias("n"), F.transform(F.filter(F.transform(ws, seen), lambda i: i.isNotNull()), lambda i: around(ws, i)).alias("at")))
    return F.get(bound, F.lit(0))


def scan(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """One row for each document: the ``keep`` columns, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated."""
    docs = docs.select(named(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *[named(c).alias(f"k{i}") for i, c in enumerate(keep or [])]).alias("row"))
    windows = materialised(windows_of(items, item_id, item_text, window))
    prefixes = materialised(with_prefix(windows, docs, "text"))
    few = prefixes.count() <= BROADCAST_WINDOWS
    send = F.broadcast if few else (lambda x: x)
    # a lone struct column, so that later projections do not repeat the scan of the text
    read = docs.select("row", _marked(F.col("text"), _bitmap(prefixes), window).alias("m")).select("row", F.explode(F.array("m")).alias("m"))
    base = materialised(read.select(F.monotonically_increasing_id().alias("rid"), "row", F.col("m.n").cast("long").alias("n_words"), F.col("m.at").alias("at")))
    at = base.where(F.size("at") > 0).select("rid", "n_words", F.explode("at").alias("m")).select("rid", "n_words", "m.*")
    start, length = F.col("i") - F.col("o"), F.size("words")
    found = (
        at.join(send(prefixes), "tok")
        .where((start >= 0) & (start + length <= F.col("n_words")) & (F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)), length) == F.col("words")))
        .select("rid", start.alias("start"), length.alias("len"), "words")
        .distinct()
    )
    found = materialised(found)
    # union of the intervals of a document
    by_start = Window.partitionBy("rid").orderBy("start")
    ends = found.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = ends.withColumn("add", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before))).groupBy("rid").agg(F.sum("add").cast("long").alias("n_hit"))
    told = windows.where(F.col("item").isNotNull()).distinct()
    which = found.select("rid", "words").distinct().join(send(told), "words").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = base.drop("at").join(hits.join(which, "rid", "left"), "rid", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    more = {"n_words": F.col("n_words"), "n_hit": n_hit, "n_items": F.size(ids).cast("long"), "item_ids": ids, "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words"))}
    return out.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep or [])], *[c.alias(added(keep or [], n)) for n, c in more.items()])


def decontaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", most_hit: int = 0, **options: object) -> DataFrame:
    """The documents with at most ``most_hit`` hit words (none at all: a passage in a long text is as bad as in a short one), with all their columns.  Equal texts share their fate, so only keys of the texts that go travel."""
    a, b = row_key(named(text_col))
    out = scan(docs.select(a.alias("a"), b.alias("b"), named(text_col).alias("text")), items, keep=["a", "b"], **options)
    return without(docs, out.where(F.col("n_hit") > most_hit).select("a", "b"), [a, b])


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scan(slim, items, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
with doc as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from documents
), item as (
  select cast(item_id as varchar) item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from benchmark
), win as (
  select distinct item, least(len(ws), 13) n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') w
  from (select item, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) i from item where len(ws) > 0)
), lens as (select distinct n from win),
spot as (
  select rid, i, n, array_to_string(ws[i : i + n - 1], ' ') w
  from (select rid, ws, unnest(range(1, len(ws) + 1)) i from doc), lens where i + n - 1 <= len(ws)
), hit as (select a.rid, a.i, a.n, win.item from spot a join win on a.w = win.w and a.n = win.n),
covered as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
named as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hit group by rid)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from doc left join covered using (rid) left join named using (rid)
"""
