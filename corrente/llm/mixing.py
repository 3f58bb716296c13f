"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(3, exp(lambda_source * size / mean size)):
the exponentially tilted rates that stay nearest to one copy each (in relative
entropy) while the expected words of the source equal its target.  The dual is
convex with one multiplier a source; Newton steps, kept inside a bracket, solve
it with one aggregation over the table of (source, size) counts per step.

Rates become copies by systematic rounding along the sizes of a source (so the
error in words stays below one document) and a few corrections that shrink that
error to the size of the smallest document that can absorb it.

Copies for equal (source, size) are dealt by a fixed hash of the row, so reruns
agree.  No document is taken more than three times.

Defined results.  Nulls: a null text has size 0, a null source is a source of
its own, ordered last; a null id hashes as null.  Documents of size 0 are taken
0 times.  Ties: equal rows share their copies, which of them takes one more is
open.  A very long text is one document whose size may exceed its source's
target; it is then taken 0 times or as the systematic rounding says, so the
source misses its target by less than that size.  Clashing names: own columns
stay, an added column of the same name gets an underscore before its name.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freed, materialised, named, order_hash, own_columns, packed_rows, unused

CAP = 3
MAX_STEPS, STEPS_A_CHECK, TOLERANCE, FIXES = 60, 6, 1e-9, 4
#: Parts into which the rows of one (source, size) are dealt, so that none is ranked in one task.
PARTS = 1024


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weighted_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """From (skey, source, source_size), one row a source: its weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target stops at ``cap`` times the source; the excess is shared by weight among the others until none is above.  In the order of cap x size / weight those that stop come first, so running sums find the common level at once."""
    one = Window.partitionBy(F.lit(0))
    by_name, by_ratio = one.orderBy(F.col("source").asc_nulls_last()), one.orderBy("ratio", "skey")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    out = out.withColumn("most", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("level", (F.sum("source_size").over(one).cast("double") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
    # the first in that order that stays below its most tells the level of all that follow
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "skey", "level"))).over(one)
    return out.withColumn("at", first["level"]).withColumn("target", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("at")))).drop("ratio", "level", "at")


def solve_dual(strata: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``lam``, each source's multiplier, to ``sources``; strata: (skey, size, n)."""
    need, have, mean = F.col("target"), F.col("source_size").cast("double"), F.col("mean_size")
    up = need >= have
    state = sources.select(
        "*",
        F.when(have <= 0, F.lit(0.0)).when(up, F.lit(0.0)).otherwise(mean * F.log(need / have)).alias("lo"),
        F.when(have <= 0, F.lit(0.0)).when(up, mean * F.log(F.lit(float(CAP)))).otherwise(F.lit(0.0)).alias("hi"),
        F.when(have <= 0, F.lit(0.0)).otherwise(F.log(need / have)).alias("lam"),
    )
    state = materialised(state.withColumn("lam", F.greatest("lo", F.least("hi", "lam"))).withColumn("off", F.lit(None).cast("double")))
    keys = [c for c in state.columns if c not in ("lam", "lo", "hi", "off")]
    for step in range(MAX_STEPS):
        both = strata.where("size > 0").join(state, "skey")
        z = F.col("size") / F.col("mean_size")
        tilt, words = F.exp(F.least(F.col("lam") * z, F.lit(50.0))), F.col("n") * F.col("size")
        # sum of rates x sizes, and its derivative where the cap does not hold
        f = F.sum(words * F.least(tilt, F.lit(float(CAP))))
        slope = F.sum(F.when(tilt < CAP, words * z * tilt).otherwise(0.0))
        nxt = both.groupBy(*keys, "lam", "lo", "hi").agg(f.alias("f"), slope.alias("slope"))
        low = F.col("f") < need
        nxt = nxt.withColumn("lo2", F.when(low, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi2", F.when(low, F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") + (need - F.col("f")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2"))
        lam = F.when(need >= CAP * have, F.col("hi")).when(F.abs(F.col("f") - need) <= TOLERANCE * need, F.col("lam")).when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        off = F.when(need >= CAP * have, 0.0).otherwise(F.abs(F.col("f") - need) / need)
        state = nxt.select(*keys, lam.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), off.alias("off"))
        if step % STEPS_A_CHECK == STEPS_A_CHECK - 1:
            state = materialised(state)
            if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
                break
    return state.drop("lo", "hi", "off")


def stratum_copies(strata: DataFrame, solved: DataFrame) -> DataFrame:
    """(skey, size, n) to these and m, the copies of its n documents together."""
    rate = F.when(F.col("target") >= CAP * F.col("source_size"), F.lit(float(CAP))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.lit(50.0))), F.lit(float(CAP))))
    by_size = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    out = strata.where("size > 0").join(solved.select("skey", "source_size", "target", "mean_size", "lam"), "skey").withColumn("r", rate)
    out = out.withColumn("upto", F.sum(F.col("n") * F.col("r")).over(by_size))
    out = out.withColumn("m", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("n") * F.col("r") + 0.5))
    out = materialised(out.withColumn("m", F.greatest(F.lit(0), F.least(F.col("m"), CAP * F.col("n"))).cast("long")).drop("r", "upto"))
    all_of = Window.partitionBy("skey")
    larger = all_of.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(FIXES):
        out = out.withColumn("gap", F.round(F.col("target")).cast("long") - F.sum(F.col("m") * F.col("size")).over(all_of))
        fits = F.col("size") <= F.abs("gap")
        slack = F.when(fits, F.when(F.col("gap") > 0, CAP * F.col("n") - F.col("m")).otherwise(F.col("m"))).otherwise(0)
        # from the largest that fit down, as many as the gap has words for
        left = F.abs("gap") - F.coalesce(F.sum(slack * F.col("size")).over(larger), F.lit(0))
        k = F.greatest(F.lit(0), F.least(slack, F.floor(left / F.col("size")).cast("long")))
        out = out.withColumn("m", F.col("m") + F.signum(F.col("gap").cast("double")).cast("long") * k).drop("gap")
    return out.select("skey", "size", "n", "m")


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3) to every row."""
    skey = F.coalesce(F.concat(F.lit("s"), named(source_col).cast("string")), F.lit("n"))
    rows = packed_rows(docs, id=id_col, skey=skey, size=size if size is not None else word_count(named(text_col)))
    rows = rows.withColumn("h", order_hash("id", "size", seed="mix")).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    parts = materialised(rows.groupBy("skey", "size", "part").agg(F.count("*").alias("k")))
    strata = materialised(parts.groupBy("skey", "size").agg(F.sum("k").alias("n")))
    of_source = strata.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    of_source = of_source.withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    sources = materialised(weighted_targets(of_source).withColumn("mean_size", F.col("source_size") / F.col("docs")).select("skey", "source_size", "target", "mean_size"))
    solved = solve_dual(strata, sources)
    copies = stratum_copies(strata, solved)
    freed(docs.sparkSession)
    by_part = Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    share = (
        parts.join(sources.drop("mean_size"), "skey")
        .join(copies.select("skey", "size", "n", "m"), ["skey", "size"], "left")
        .withColumn("before", F.coalesce(F.sum("k").over(by_part), F.lit(0)))
        .select(
            "skey", "size", "part", "source_size", "target",
            F.coalesce(F.floor(F.col("m") / F.col("n")), F.lit(0)).cast("long").alias("base"),
            F.coalesce(F.col("m") % F.col("n") - F.col("before"), F.lit(0)).alias("extra"),
        )
    )
    on = ["skey", "size", "part"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy("h", "id")))
    out = ranked.join(materialised(share), on)
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")}
    return out.select(*own_columns(docs), *[c.alias(unused(docs, n)) for n, c in added.items()])


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns alone."""
    rows = packed_rows(docs, **{x: options.get(f"{x}_col", d) for x, d in (("source", "source"), ("text", "text"), ("doc_id", "doc_id"))})
    out = mix(rows.withColumn("words", word_count(F.col("text"))).drop("text"), size=F.col("words")).where("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select(*own_columns(docs))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words the mix takes of the document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("words"))
    out = mix(materialised(slim), size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
