"""One-permutation MinHash fingerprints, in DataFrame functions only.

A text's five-word shingles are hashed once; the top bits of a hash choose one of ``BINS`` bins,
which keeps its least hash.  An empty bin borrows from the first filled bin in a probe order of
its own (optimal densification: independent probes; a permutation of all bins, so it always ends).
Of every bin's value, hashed with the bin, the low ``BITS`` bits are kept, packed into 64-bit words; a fingerprint's text form is
those words in hexadecimal.  Equal bins overstate likeness by chance agreement of 2^-BITS, which
``likeness`` takes out.

Words are runs of anything but ASCII blanks, A-Z lower-cased; a text of fewer than five words is one
shingle.  Defined results: null, empty and blank texts share the fingerprint ``EMPTY``, alike (1.0)
to each other and not (0.0) to any other.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, global_order, lower_ascii, with_next, words_of

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 8
PER_WORD = 64 // BITS
EMPTY = "empty"


def _bin(h):
    return F.shiftrightunsigned(h, 64 - (BINS.bit_length() - 1)).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: array<bigint> of packed bins (null without words) for string column ``text``."""
    words, hashes, least, slots, dense = (f"_{name}_{x}" for x in ("words", "hashes", "least", "slots", "dense"))
    keep = [F.col(c) for c in df.columns]
    df = df.withColumn(words, words_of(lower_ascii(F.col(text))))
    # every step names its input more than once, so the planner keeps it as a column instead of
    # repeating it inside the loop over elements
    df = df.withColumn(hashes, F.when(F.size(words) > 0, F.sort_array(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))),
        lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))))
    # sorted, a bin's hashes stand together, the least first
    df = df.withColumn(least, F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(hashes), i - 1)))))
    df = df.withColumn(slots, F.map_from_arrays(F.transform(least, _bin), F.col(least)))
    df = df.withColumn(dense, F.when(F.size(slots) > 0, F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.try_element_at(F.col(slots), j))))

    def value(j):
        hits = [F.get(F.col(dense), F.pmod(F.xxhash64(j, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
        # whoever misses that often looks through the filled bins, in a random order of its own
        rest = F.array_min(F.transform(F.map_keys(slots), lambda b: F.struct(
            F.xxhash64(j, b, F.lit(PROBES)).alias("rank"), F.try_element_at(F.col(slots), b).alias("v"))))
        found = F.coalesce(F.get(F.col(dense), j), *hits, rest["v"])
        # hashed with its bin: bins that borrow one value then agree by chance independently
        return F.xxhash64(found, j).bitwiseAND(F.lit((1 << BITS) - 1))

    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda w: F.aggregate(
        F.slice(F.col(f"_{name}_full"), w * PER_WORD + 1, PER_WORD), F.lit(0).cast("long"),
        lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)))
    df = df.withColumn(f"_{name}_full", F.when(F.col(dense).isNotNull(), full))
    df = df.withColumn(name, F.when(F.size(f"_{name}_full") > 0, packed))
    return df.select(*keep, name)


def as_text(packed):
    """A fingerprint's text form."""
    digits = F.array_join(F.transform(packed, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
    return F.coalesce(digits, F.lit(EMPTY))


def likeness(a, b):
    """Estimated share of common shingles (Jaccard) of two packed fingerprints, 0 to 1."""
    ones = F.lit(sum(1 << (BITS * i) for i in range(PER_WORD)))

    def differing(x, y):
        bits = x.bitwiseXOR(y)
        for shift in (1, 2):  # folds the four bits of each bin onto its lowest
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(ones)).cast("int")

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0 ** -BITS
    estimate = F.greatest(F.lit(0.0), ((1 - differ / BINS) - chance) / (1 - chance))
    return (F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0))
            .otherwise(estimate))


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited forms, and likenesses to those and to the next text.

    The edited text is the text with its last quarter (rounded down) replaced by the beginning of
    the next document's, in ascending key order (nulls first; equal keys by a hash of the text; the
    last is followed by the first).  Rows equal in key and text are one document and get one result
    each.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(docs[key].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # never null, so that joins compare plain columns and keep the texts where they are
    rows = rows.withColumns({"k": F.coalesce(F.col("id").cast("string"), F.lit("null")), "h": F.xxhash64("text")})
    keys = rows.groupBy("id", "k", "h").agg(F.count("*").alias("times"), F.first(F.length("text")).alias("n"))
    keys = global_order(scratch, keys, ["id", "h"], "keys")
    first = keys.orderBy("_uid").limit(1).select("k", "h", "n").first()
    wrap = F.struct(*[F.lit(first[c] if first else None).cast(keys.schema[c].dataType).alias(c) for c in ("k", "h", "n")])
    keys = scratch.settle(with_next(keys, ["k", "h", "n"]).select(
        "id", "k", "h", "times", "n", F.coalesce("_next", wrap).alias("next")), "next")

    # one row per key; both joins below read the same shuffle of the texts
    texts = rows.groupBy("k", "h").agg(F.first("text").alias("text"))
    carried = ["id", "k", "h", "times", "n", "next_k", "next_h"]
    wanted = keys.select("id", "k", "h", "times", "n", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"),
                         F.least(F.floor(F.col("n") / 4).cast("int"), F.col("next.n")).alias("taken"))
    source = texts.select(F.col("k").alias("sk"), F.col("h").alias("sh"), F.col("text").alias("stext"))
    heads = wanted.join(source, (wanted["next_k"] == source["sk"]) & (wanted["next_h"] == source["sh"])).select(
        *carried, F.substring("stext", F.lit(1), F.col("taken")).alias("head"))
    own = texts.select(F.col("k").alias("ok"), F.col("h").alias("oh"), "text")
    both = heads.join(own, (heads["k"] == own["ok"]) & (heads["h"] == own["oh"])).select(
        *carried, "text",
        F.concat(F.substring("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 4).cast("int")), "head").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    printed = with_fingerprint(with_fingerprint(both, "text", "packed"), "edited", "edited_packed")
    printed = scratch.settle(printed.drop("text", "edited"), "printed")
    other = printed.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("packed").alias("next_packed"))
    out = printed.join(other, (printed["next_k"] == other["nk"]) & (printed["next_h"] == other["nh"]))
    return out.select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).drop("_copy")
