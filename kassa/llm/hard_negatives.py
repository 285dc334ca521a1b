"""Hard negatives by inner product with coordinate pruning.

Vectors become whole numbers (floor of ``SCALE`` times each component) and are range-sorted by length, longest
first.  A task reads its stretch of that order and cuts it into length buckets; a bucket keeps, for every
coordinate, its normalised vectors' values as a sorted list.  Anchors come in blocks of a fixed number of
components, one broadcast each, and every block is searched through all buckets:

1. An anchor's bar is the least score that may still enter its lists: the window's lower end, or the last place of
   a full list.  A bucket whose longest vector cannot reach the bar is skipped.
2. Where the bar is positive, a vector of the bucket that reaches it lies within an angle of the anchor, so its
   value in each focus coordinate (those where the anchor is largest) lies in a range.  Binary search in
   the sorted lists turns the ranges into intervals, and the intervals' rows are intersected.
3. What is left is scored exactly in whole numbers, and the best of each list stay.

Positives are one such search (same label, no window), negatives a second one with a window for every
different score among an anchor's positives.  A task hands on at most its lists; Spark merges them.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null key
is never an anchor and loses every tie; rows with equal keys are separate rows (each may be an anchor, and
the others' positive); vectors of different lengths are filled up with zeros; scaled components beyond
2^26 count as that, so that scores of up to 1,024 components fit a long; a positive without a fitting negative gives no row; an empty
table gives none.  Only the key, the label and the vector are read, whatever other columns there are.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, global_order, numbered

SCALE, LARGEST = 256, 1 << 26
POSITIVES, NEGATIVES = 5, 10
#: components in one broadcast block of anchors; vectors in a bucket; anchors scored at once; focus coordinates
COMPONENTS, BUCKET, AT_ONCE, FOCUS = 1 << 20, 2048, 256, 4
#: a bucket of at least SHORT vectors ends where lengths fall below this share of its first
SHORT, RATIO = 256, 0.9
NEVER, LAST = -(1 << 62), np.iinfo(np.int64).max

_FOUND = "anchor long, slot int, score long, key long, keyless boolean, row long"


def scaled(vector: Column) -> Column:
    """The whole-number vector, null where the vector may take no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, bound), -bound)).cast("int"))
    return F.when(usable, whole)


def by_length(scratch: Scratch, rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(key, label, v, length, _part, _uid), longest first; ``_uid`` is the row's identity."""
    use = rows.select(rows[key].cast("long").alias("key"), label.cast("long").alias("label"), scaled(rows[vector]).alias("v"))
    use = use.where("label IS NOT NULL AND v IS NOT NULL")
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    use = use.withColumn("length", F.sqrt(square))
    order = [F.col("length").desc(), F.col("key").asc_nulls_last(), F.xxhash64("label", "v")]
    return global_order(scratch, use, order, "vectors")


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dimensions).all():
        return values.reshape(len(sizes), dimensions).astype(np.float64)
    out = np.zeros((len(sizes), dimensions))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = values
    return out


class Anchors:
    """One block of anchors with the lists they ask for (``low``, ``high``: slots x anchors)."""

    def __init__(self, table: pa.Table, dimensions: int, same: bool, k: int, low: np.ndarray, high: np.ndarray):
        table = table.combine_chunks()
        self.row, self.label = (table.column(c).to_numpy() for c in ("_uid", "label"))
        self.length = table.column("length").to_numpy()
        column = table.column("v")
        self.v = _matrix(column.chunk(0) if column.num_chunks else pa.array([], column.type), dimensions)
        self.same, self.k, self.low, self.high = same, k, low, high
        unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.angles = np.arccos(np.clip(np.take_along_axis(unit, self.focus, 1), -1, 1))


class Bucket:
    """Vectors of similar length, with a sorted list per coordinate."""

    def __init__(self, v, length, label, key, keyless, row):
        self.v, self.length, self.label, self.key, self.keyless, self.row = v, length, label, key, keyless, row
        unit = v / np.maximum(length, 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, order, 0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(v), dtype=np.int32)[:, None], 0)

    def candidates(self, focus: np.ndarray, angles: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """anchors x vectors: within ``reach`` (the widest angle allowed) in every focus coordinate."""
        out = np.ones((len(focus), len(self.v)), bool)
        low = np.cos(np.minimum(angles + reach[:, None], np.pi)) - 1e-9
        high = np.cos(np.maximum(angles - reach[:, None], 0)) + 1e-9
        for j in range(focus.shape[1]):
            for f in np.unique(focus[:, j]):
                of = np.flatnonzero(focus[:, j] == f)
                begin = np.searchsorted(self.lists[:, f], low[of, j], "left")
                end = np.searchsorted(self.lists[:, f], high[of, j], "right")
                narrow = end - begin < len(self.v)
                if narrow.any():
                    place = self.place[None, :, f]
                    out[of[narrow]] &= (place >= begin[narrow, None]) & (place < end[narrow, None])
        return out


def buckets(batch: pa.RecordBatch, dimensions: int) -> Iterator[Bucket]:
    length = batch.column("length").to_numpy()
    order = np.argsort(-length, kind="stable")
    keys = batch.column("key")
    keyless = keys.is_null().to_numpy(zero_copy_only=False)
    key = keys.fill_null(LAST).to_numpy(zero_copy_only=False)
    v = _matrix(batch.column("v"), dimensions)
    label, row = (batch.column(c).to_numpy() for c in ("label", "_uid"))
    at = 0
    while at < len(order):
        falls = np.searchsorted(-length[order], -RATIO * length[order[at]], "right")
        end = min(at + BUCKET, max(int(falls), at + SHORT), len(order))
        of = order[at:end]
        yield Bucket(v[of], length[of], label[of], key[of], keyless[of], row[of])
        at = end


class Lists:
    """The best k of every list so far: score, key, keyless and row, in order."""

    def __init__(self, slots: int, anchors: int, k: int):
        self.k = k
        self.score = np.full((slots, anchors, k), NEVER, np.int64)
        self.key, self.row = np.full(self.score.shape, LAST), np.full(self.score.shape, -1)
        self.keyless = np.zeros(self.score.shape, bool)

    def add(self, slot: int, anchor, score, key, keyless, row) -> None:
        """Merges finds into one slot's lists; ``anchor`` holds indices of anchors."""
        of = np.unique(anchor)
        kept = self.score[slot, of] > NEVER
        old = np.repeat(of, self.k).reshape(len(of), self.k)[kept]
        anchor = np.concatenate([old, anchor])
        score = np.concatenate([self.score[slot, of][kept], score])
        key = np.concatenate([self.key[slot, of][kept], key])
        keyless = np.concatenate([self.keyless[slot, of][kept], keyless])
        row = np.concatenate([self.row[slot, of][kept], row])
        order = np.lexsort((row, keyless, key, -score, anchor))
        ranked = anchor[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        rank = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
        order, ranked, rank = order[rank < self.k], ranked[rank < self.k], rank[rank < self.k]
        for mine, new in ((self.score, score), (self.key, key), (self.keyless, keyless), (self.row, row)):
            mine[slot, ranked, rank] = new[order]


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    return (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def search_bucket(a: Anchors, b: Bucket, lists: Lists) -> None:
    longest = float(b.length.max())
    largest = np.abs(a.v).max(initial=0) * np.abs(b.v).max(initial=0) * a.v.shape[1]
    exact = largest < 2 ** 53
    for at in range(0, len(a.row), AT_ONCE):
        c = np.arange(at, min(at + AT_ONCE, len(a.row)))
        # a full list's last place is its bar: an equal score may still win by its key
        bars = np.maximum(a.low[:, c], lists.score[:, c, -1])
        bar = np.where(a.low[:, c] <= a.high[:, c], bars, LAST).min(axis=0).astype(np.float64)
        reached = a.length[c] * longest * (1 + 1e-9) >= bar
        c, bars, bar = c[reached], bars[:, reached], bar[reached]
        if not len(c):
            continue
        product = np.maximum(a.length[c] * longest, 1e-300)
        # with room for the rounding of an angle near zero
        reach = np.where(bar > 0, np.arccos(np.clip(bar / product, -1, 1)) + 1e-7, np.pi)
        use = b.candidates(a.focus[c], a.angles[c], reach)
        use &= (a.label[c][:, None] == b.label) if a.same else (a.label[c][:, None] != b.label)
        if a.same:
            use &= a.row[c][:, None] != b.row
        if not use.any():
            continue
        if use.mean() < 0.02:
            i, j = np.nonzero(use)
            score = np.full(use.shape, NEVER, np.int64)
            left, right = (a.v[c][i], b.v[j]) if exact else (a.v[c][i].astype(np.int64), b.v[j].astype(np.int64))
            score[i, j] = np.einsum("ij,ij->i", left, right).astype(np.int64)
        else:
            score = np.where(use, _scores(a.v[c], b.v, exact), NEVER)
        for slot in range(len(a.low)):
            fits = np.where((score >= bars[slot][:, None]) & (score <= a.high[slot, c][:, None]), score, NEVER)
            if fits.shape[1] > a.k:
                fits[fits < np.partition(fits, -a.k, axis=1)[:, -a.k][:, None]] = NEVER
            i, j = np.nonzero(fits > NEVER)
            if len(i):
                lists.add(slot, c[i], fits[i, j], b.key[j], b.keyless[j], b.row[j])


def search(vectors: DataFrame, anchors: Anchors) -> DataFrame:
    """The lists of a block of anchors over all ``vectors``: anchor (row), slot, score, key, keyless, row."""
    sc = vectors.sparkSession.sparkContext
    shared, dimensions, k = sc.broadcast(anchors), anchors.v.shape[1], anchors.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, lists = shared.value, None
        for batch in batches:
            for bucket in buckets(batch, dimensions):
                lists = lists or Lists(len(a.low), len(a.row), k)
                search_bucket(a, bucket, lists)
        if lists is not None:
            slot, anchor, place = np.nonzero(lists.score > NEVER)
            yield pa.RecordBatch.from_pydict({
                "anchor": a.row[anchor], "slot": slot.astype(np.int32), "score": lists.score[slot, anchor, place],
                "key": lists.key[slot, anchor, place], "keyless": lists.keyless[slot, anchor, place],
                "row": lists.row[slot, anchor, place]})

    found = vectors.select("_uid", "key", "label", "v", "length").mapInArrow(run, _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "key", "keyless", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label",
         vector: str = "embedding", low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``key`` that tells which rows are anchors; a negative's score must lie
    between ``low`` and ``high`` (fractions) of its positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    label = rows[label] if isinstance(label, str) else label
    vectors = by_length(scratch, rows, key, label, vector)
    asked = vectors.where(anchor).drop("_part").withColumnRenamed("_uid", "_row")
    asked = numbered(global_order(scratch, asked, [F.col("key"), F.col("_row")], "anchors"), "place")
    asked = scratch.settle(asked.drop("_part", "_uid").withColumnRenamed("_row", "_uid"), "asked")
    size = vectors.agg(F.max(F.size("v")).alias("dimensions")).first()
    dimensions, n_anchors = max(size["dimensions"] or 1, 1), asked.count()
    per_block = max(1, COMPONENTS // dimensions)
    out = []
    for begin in range(0, n_anchors, per_block):
        # at most ``per_block`` anchors: a bounded broadcast
        block = asked.where((F.col("place") >= begin) & (F.col("place") < begin + per_block)).drop("place").toArrow()
        n = len(block)
        any_score = np.full((1, n), NEVER + 1, np.int64), np.full((1, n), -NEVER, np.int64)
        first = Anchors(block, dimensions, True, POSITIVES, *any_score)
        positives = scratch.settle(search(vectors, first), "positives")
        # at most five scores an anchor
        scores = positives.select("anchor", "score").distinct().toPandas()
        scores["slot"] = scores.groupby("anchor")["score"].rank(method="first").astype(int) - 1
        windows = np.full((POSITIVES, n), 1, np.int64), np.full((POSITIVES, n), 0, np.int64)
        at = pd.Series(np.arange(n), index=first.row).reindex(scores["anchor"]).to_numpy().astype(int)
        windows[0][scores["slot"], at] = [-(-s * low[0] // low[1]) for s in scores["score"].tolist()]
        windows[1][scores["slot"], at] = [s * high[0] // high[1] for s in scores["score"].tolist()]
        second = Anchors(block, dimensions, False, NEGATIVES, *windows)
        slots = spark.createDataFrame(scores.astype("int64"), "anchor long, score long, slot long")
        negatives = search(vectors, second).select(
            F.col("anchor").alias("a"), F.col("slot").alias("s"), "rank", F.when(~F.col("keyless"), F.col("key")).alias("negative_id"),
            F.col("score").alias("negative_score"))
        keys = asked.select(F.col("_uid").alias("u"), F.col("key").alias("anchor_id"))
        pairs = positives.select("anchor", "score", F.when(~F.col("keyless"), F.col("key")).alias("positive_id")).join(
            slots, ["anchor", "score"])
        pairs = pairs.join(keys, F.col("anchor") == F.col("u")).join(
            negatives, (F.col("anchor") == F.col("a")) & (F.col("slot") == F.col("s")))
        out.append(scratch.settle(pairs.select(
            "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"), "mined"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    schema = out[0].schema
    return spark.read.schema(schema).parquet(*[t._kassa_path for t in out])
