"""Mixing sources to target weights by systematic sampling.

Every source's target is its weight's share of all words, at most ``LIMIT`` times what it has; the excess is
shared again by weight until no source is above.  A document's expected copies are its source's target over
its source's size.  Within a source the documents are put in order of size, their expected copies are
prefix-summed, one random offset per source is added, and a document comes out once for every integer
boundary that its stretch of the sum crosses.  Ordered by size, neighbours stand in for each other, so the
words taken differ from the target by no more than about the largest document.

Only the fractional part of a prefix sum decides what is crossed, so sums are kept in units of 2^-32 and
carried from one range partition to the next modulo 1.  Documents are range-sorted by (source, size, key):
a source that holds most rows spreads over partitions, and what passes between them is one row per
partition and source.

Defined results: null and blank texts have size 0 and are sampled like any other; a null source is a source
of its own, after all others; repeated rows are separate documents; ties of size go to the smaller key (nulls
first), then to the text's hash, and rows equal in all of that are interchangeable; no document is taken
more than ``LIMIT`` times; an empty table gives an empty result.  The offset is a digest of the seed and the
source's place, so a second run takes the same documents.  The caller's columns travel in the struct ``row``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, global_order, numbered

#: units of one copy; most copies of a document
ONE, LIMIT = 1 << 32, 3
WEIGHTS, SEED = (5, 2, 1), "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered_sources(scratch: Scratch, sized: DataFrame) -> DataFrame:
    """(source, source_size, place): the sources by code point, null last, numbered from 0."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = global_order(scratch, sizes, [F.col("source").asc_nulls_last()], "sources")
    return numbered(ordered, "place").select("source", "source_size", "place")


def with_targets(scratch: Scratch, sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds ``target`` and ``step``, the expected copies of each of its documents in units of 2^-32.

    Every round is one aggregate over the sources: with those known to be above their limit set to it, the rest
    share what is left by weight.  A share only grows from round to round, so a source once above stays
    above, and the loop ends when a round finds none.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.settle(sources.withColumn("weight", weight.cast("long")), "weights")
    limit = LIMIT * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, shares, above = total, table.agg(F.sum("weight")).first()[0] or 1, -1
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(shares))
        full = share > limit
        row = table.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit)).alias("taken"),
                        F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if (row["n"] or 0) <= above or not row["weights"]:
            break
        above, left, shares = row["n"] or 0, total - (row["taken"] or 0), row["weights"]
    target = F.when(full, limit.cast("double")).otherwise(share)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(ONE))))
    return table.withColumn("target", target).select(
        "source", "source_size", "place", "target", F.least(F.coalesce(step, F.lit(0)), F.lit(LIMIT * ONE)).alias("step"))


def offset(place: Column, seed: str) -> Column:
    """A source's random offset in units of 2^-32."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), place.cast("string"))), 1, 8), 16, 10).cast("long")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           carry: list[str] | None = None, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """``row`` (the caller's columns, or those in ``carry``), size, source_size, target, n_copies, taken."""
    scratch = Scratch(docs.sparkSession, "source-mixing")
    row = F.struct(*[docs[c] for c in (docs.columns if carry is None else carry)]).alias("row")
    sized = docs.select(row, docs[key].alias("key"), docs[source].cast("string").alias("source"),
                        n_words(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("mark"))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("key").asc_nulls_first(), F.col("mark")]
    ordered = global_order(scratch, sized, order, "documents")
    targets = with_targets(scratch, numbered_sources(scratch, ordered), weights)

    # sources and what each holds in each partition: small tables, one row per pair that occurs
    held = ordered.groupBy("_part", F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    held = held.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    earlier = Window.partitionBy("place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # n * step stays below 2^63 for any partition of less than 2^29 rows
    carried = F.coalesce(F.sum((F.col("n") * F.col("step")) % ONE).over(earlier), F.lit(0))
    held = held.withColumn("start", (carried + offset(F.col("place"), seed)) % ONE)
    held = scratch.settle(held.select(F.col("_part").alias("p"), "s", "place", "source_size", "target", "step", "start"), "held")

    joined = ordered.join(held, (F.col("_part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    up_to = Window.partitionBy("_part", "place").orderBy("_uid").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("step").over(up_to) + F.col("start")
    crossed = F.shiftright(end, 32) - F.shiftright(end - F.col("step"), 32)
    return joined.withColumn("n_copies", crossed.cast("long")).select(
        "row", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mixture itself: ``row`` and ``copy`` (from 1), one row per copy taken."""
    taken = copies(docs, key, text, source, None, weights, seed).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"))
