"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents become token pieces of at most ``CAPACITY`` tokens; full pieces are sequences of their own.
The others are packed in rounds.  A round sorts unplaced pieces and open gaps by size, sweeps upwards and
gives every gap the largest piece below it that no tighter gap has taken, like matching brackets: a
piece opens, a gap closes.  Pieces of one size that want the same gaps are told apart by rank.  Then
gaps are updated and the next round begins.  The largest unplaced pieces open new sequences, but never
more than the unplaced tokens need beyond the room left in open gaps, or the pieces that no gap fits.

The sweep is distributed.  There are at most ``CAPACITY`` sizes, so a small table of counts by
size gives every piece and gap its depth of open brackets from its rank within its size, and a piece
matches the next gap at the same depth.  Ranks come from windows over (size, hash bucket), so a size that
a third of all rows share spreads over the buckets; a depth holds two rows per size at most.

Small pieces would need many rounds, one per gap and round.  So a gap is offered as several slots
when the largest unplaced piece that fits it does so more than once.

Defined results: null texts are empty and have one piece, the end id alone; repeated rows are pieces
of their own; an empty table gives no rows.
"""
from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, give_back_memory

CAPACITY, END_ID = 4096, 1
#: entries remembered per worker, bytes of text whose words are told apart together, and new words that the
#: library gets at once (what it makes of a word takes many times the word's size)
WORDS, TOGETHER, AT_ONCE = 900_000, 2 << 20, 8_000
#: what a round's tables say; a piece without a sequence is left for the next round
PLACED = "uid long, seq long, round int, slot int, size long"


#: ASCII characters other than letters, digits and blanks
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _all_letters(word: bytes) -> bool:
    """Whether a word is a run of letters, and stays one in lower case."""
    if word.isascii():
        return word.isalpha()
    word = word.decode("utf-8", "replace")
    return word.isalpha() and word.lower().isalpha()


class WordTokenizer:
    """Token ids of texts, from remembered ids of their blank-separated words.

    For tokenizers that drop white space, never join across it, lower-case A-Z, split a run of letters
    from other characters, and mark the last token of each run with ``</w>``.

    Arrow splits texts and tells their different words; ids are looked up once per different word and laid
    out by place.  Remembered words are in two halves: a full one becomes the older, and what is still met in
    the older moves on, so frequent words are not learned again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different words, by the library."""
        out = {}
        for at in range(0, len(words), AT_ONCE):
            some = words[at: at + AT_ONCE]
            letters = [w for w in some if _all_letters(w)]
            if letters:
                # one text of all of them: each is one run of letters and ends with a marked token
                text = b" ".join(letters).decode("utf-8", "replace")
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) == len(letters):
                    raw = ids.tobytes()
                    out.update((w, raw[i:j]) for w, i, j in zip(letters, [0, *cuts.tolist()], cuts.tolist()))
            other = [w for w in some if w not in out]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, found))
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different words that are not remembered."""
        ended, runs, new = [], {}, []
        for w in words:
            run = w.rstrip(_SIGNS)
            if len(run) < len(w) and _all_letters(run):
                # letters, then other characters: two runs, whose ids do not depend on each other
                ended.append((w, run, w[len(run):]))
            else:
                new.append(w)
        runs = {r: self.known.get(r) or self.older.get(r) for _, *both in ended for r in both}
        runs.update(self._encoded(list({*new, *[r for r, ids in runs.items() if not ids]})))
        runs.update([(w, runs[a] + runs[b]) for w, a, b in ended])
        return runs

    def _found(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; those met for the first time are remembered."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = {words[i]: self.older.get(words[i]) for i in missing}
            new.update(self._learn([w for w, ids in new.items() if ids is None]))
            for i in missing:
                found[i] = new[words[i]]
            if len(self.known) + len(new) > WORDS // 2:
                self.known, self.older = {}, self.known
            self.known.update(new)
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and the last one's end."""
        # a special token's spelling counts
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        found = self._found(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        table = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        begin, n = (np.cumsum(length) - length)[word], length[word]
        end = np.cumsum(n)
        at = np.repeat(begin - (end - n), n) + np.arange(n.sum())
        return table[at], np.concatenate([[0], end])[split.offsets.to_numpy()]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: one piece of a document
PIECE = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "crc": pa.int64()}


def cut(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Per document the list of its pieces, END_ID included; only longer documents are cut."""
    ids = np.insert(ids, bounds[1:], END_ID)
    size = np.diff(bounds) + 1
    n = -(-size // CAPACITY)
    last = np.cumsum(n)
    piece = np.arange(n.sum()) - np.repeat(last - n, n)
    start = piece * CAPACITY
    length = np.minimum(np.repeat(size, n) - start, CAPACITY)
    begin = np.cumsum(length) - length
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * i: 4 * j]) for i, j in zip(begin.tolist(), (begin + length).tolist())]
    columns = [pa.array(c, kind) for c, kind in zip((piece, start, length, crc), PIECE.values())]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]), pa.int32()), pa.StructArray.from_arrays(columns, list(PIECE)))


def tokenised(docs: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(id, piece, start, length, crc) of every document."""
    @F.arrow_udf("array<struct<piece: int, start: bigint, length: bigint, crc: bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        t, out = _tokenizer(tokenizer), []
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER)))
            out.append(cut(*t.ids(texts.slice(at, to - at))))
            at = to
        give_back_memory()  # the worker may wait for its next task beside other steps' tasks
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct(list(PIECE.items()))))

    return docs.select(docs[key].alias("id"), F.explode(run(F.coalesce(docs[text], F.lit("")))).alias("p")).select("id", "p.*")


def _ranked(items: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """``items`` with ``rank`` (from 1) among the rows equal in ``by``, ordered by bucket and uid."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("uid", "slot"), F.lit(buckets)).cast("int"))
    # one row per size, kind and bucket, summed before the shuffle
    counts = items.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in [*by, "bucket"]], "before")
    inside = Window.partitionBy(*by, "bucket").orderBy("uid", "slot")
    items = items.withColumn("rank", F.row_number().over(inside))
    on = [F.col(c) == F.col(f"c_{c}") for c in [*by, "bucket"]]
    return items.join(counts, on).withColumn("rank", F.col("rank") + F.col("before")).select(
        *by, "uid", "slot", "rank")


def _counts(items: DataFrame, size) -> dict[int, int]:
    """Rows by size; at most CAPACITY entries."""
    return {r["size"]: r["count"] for r in items.groupBy(size.cast("int").alias("size")).count().collect()}


def _wanted(pieces: dict[int, int], gaps: dict[int, int]) -> int:
    """New sequences that no packing of the unplaced pieces can do without, given the open gaps."""
    largest, smallest = max(gaps, default=0), min(pieces)
    room = sum(g * n for g, n in gaps.items() if g >= smallest)
    beyond = {s: n for s, n in pieces.items() if s > largest}
    return max(-(-(sum(s * n for s, n in pieces.items()) - room) // CAPACITY),
               -(-sum(s * n for s, n in beyond.items()) // CAPACITY),
               sum(n for s, n in beyond.items() if s > CAPACITY // 2))


def _slots(pieces: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int]]:
    """(gap, slots, size of a slot) of the gap sizes that fit a piece.

    A gap holds the largest piece that fits it so many times; no more slots than pieces are left for them.
    """
    fits, largest = {}, 0
    for g in range(1, CAPACITY + 1):
        largest = g if g in pieces else largest
        fits[g] = largest
    offers = sorted((g // (g // fits[g]), g, g // fits[g]) for g in gaps if 0 < g and fits[g])
    out, open_, below = [], 0, 0
    for size, g, n in offers:
        open_ += sum(pieces.get(s, 0) for s in range(below + 1, size + 1))
        below = max(below, size)
        n = min(n, -(-open_ // gaps[g]))
        if n:
            out.append((g, n, size))
            open_ -= min(open_, n * gaps[g])
    return out


def _seeds(left: DataFrame, pieces: dict[int, int], wanted: int, buckets: int) -> tuple[DataFrame, dict[int, int]]:
    """The ``wanted`` largest of ``left`` (uid, size), and their counts by size."""
    taken, part = {}, None
    for size in sorted(pieces, reverse=True):
        if wanted > 0:
            taken[size] = min(pieces[size], wanted)
            wanted -= taken[size]
            part = size if taken[size] < pieces[size] else None
    out = left.where(F.col("size") >= min(taken))
    if part is not None:
        tied = _ranked(left.where(F.col("size") == part).withColumn("slot", F.lit(0)), ["size"], buckets)
        out = left.where(F.col("size") > part).unionByName(tied.where(F.col("rank") <= taken[part]).select("uid", "size"))
    return out, taken


def _match(left: DataFrame, gaps: DataFrame, buckets: int) -> DataFrame:
    """Every unplaced piece (uid, size) with the sequence and slot it gets, if any."""
    items = left.select("uid", F.lit(0).alias("slot"), "size", F.lit(0).alias("kind")).unionByName(
        gaps.select("uid", "slot", "size", F.lit(1).alias("kind")))
    ranked = _ranked(items, ["size", "kind"], buckets)
    # at most CAPACITY rows: open brackets below each size
    counts = items.groupBy("size").agg(F.count_if(F.col("kind") == 0).alias("pieces"),
                                       F.count_if(F.col("kind") == 1).alias("gaps"))
    below = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("size").alias("c_size"), "pieces",
                           F.coalesce(F.sum(F.col("pieces") - F.col("gaps")).over(below), F.lit(0)).alias("open"))
    ranked = ranked.join(F.broadcast(counts), F.col("size") == F.col("c_size"))
    depth = F.col("open") + F.when(F.col("kind") == 0, F.col("rank")).otherwise(F.col("pieces") - F.col("rank") + 1)
    level = Window.partitionBy("depth").orderBy("size", "kind")
    following = F.lead(F.struct("kind", "uid", "slot")).over(level)
    out = ranked.withColumn("depth", depth).withColumn("next", following).where(F.col("kind") == 0)
    hit = F.col("next.kind") == 1
    return out.select("uid", "size", F.when(hit, F.col("next.uid")).alias("seq"), F.when(hit, F.col("next.slot")).alias("slot"))


def place(scratch: Scratch, pieces: DataFrame) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, size)."""
    buckets = max(8, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = pieces.where(F.col("size") == CAPACITY).select(
        "uid", F.col("uid").alias("seq"), F.lit(0).alias("round"), F.lit(0).alias("slot"), "size")
    placed = []
    left, bins, rounds = pieces.where(F.col("size") < CAPACITY).select("uid", "size"), None, 0
    gap = F.lit(CAPACITY) - F.col("used")
    while True:
        rounds += 1
        scratch.release()
        sizes = _counts(left, F.col("size"))
        if not sizes:
            break
        room = {} if bins is None else _counts(bins.where(F.col("used") < CAPACITY), gap)
        wanted = _wanted(sizes, room)
        if wanted > 0:
            seeds, taken = _seeds(left, sizes, wanted, buckets)
            seeds = scratch.settle(seeds.select(
                "uid", F.col("uid").alias("seq"), F.lit(rounds).alias("round"), F.lit(0).alias("slot"), "size"), "seeds")
            placed.append(seeds._kassa_path)
            opened = seeds.select(F.col("uid").alias("seq"), F.col("size").alias("used"))
            bins = opened if bins is None else bins.unionByName(opened)
            left = scratch.settle(left.join(seeds.select(F.col("uid").alias("s")), F.col("uid") == F.col("s"), "left_anti"), "left")
            for size, n in taken.items():
                sizes[size] -= n
                room[CAPACITY - size] = room.get(CAPACITY - size, 0) + n
            sizes = {s: n for s, n in sizes.items() if n}
        offers = _slots(sizes, room)
        if not offers:
            continue
        # at most CAPACITY rows
        offered = scratch.spark.createDataFrame(offers, "gap int, n int, slot_size long")
        gaps = bins.withColumn("free", gap.cast("int")).join(F.broadcast(offered), F.col("free") == F.col("gap")).select(
            F.col("seq").alias("uid"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"),
            F.col("slot_size").alias("size"))
        met = scratch.settle(_match(left, gaps, buckets).withColumn("round", F.lit(rounds)), "met")
        placed.append(met._kassa_path)
        hits = met.where(F.col("seq").isNotNull())
        grown = hits.groupBy(F.col("seq").alias("g")).agg(F.sum("size").alias("more"))
        bins = scratch.settle(bins.join(grown, F.col("seq") == F.col("g"), "left").select(
            "seq", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")), "bins")
        left = met.where(F.col("seq").isNull()).select("uid", "size")
    everything = full
    if placed:  # the rounds' tables in one scan: a union's plan would grow with the rounds
        rest = scratch.spark.read.schema(PLACED).parquet(*placed)
        everything = full.unionByName(rest.where(F.col("seq").isNotNull()))
    # at most CAPACITY pieces share a sequence
    inside = Window.partitionBy("seq").orderBy("round", "slot", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return everything.select("uid", F.col("seq").alias("sequence_id"),
                             F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    scratch = Scratch(docs.sparkSession, "best-fit-packing")
    pieces = scratch.settle(tokenised(docs, key, text, tokenizer).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    at = place(scratch, pieces.select("uid", F.col("length").alias("size"))).withColumnRenamed("uid", "u")
    return pieces.join(at, F.col("uid") == F.col("u")).select(
        F.col("id").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
