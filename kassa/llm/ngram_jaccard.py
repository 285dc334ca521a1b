"""Exact Jaccard links between documents' shingle sets, by prefixes under several token orders.

Two sets with Jaccard >= t share at least m tokens among the first n - ceil(t n) + m of each, under
*every* global order of tokens and for every m; here m is 1 + n / 16 of the smaller set.  So:

1. Texts with equal shingle sets form a class; from here on a class is one node.
2. Every node emits its prefix under the first order; the nodes of a token are its bucket.  Sets whose
   sizes differ by more than t are no pair, so a row without a neighbour near in size goes, and so
   does a node with fewer than m rows left: it shares too little with all others together.
   Orders put rarer tokens first: tokens that come up often inside some stretch of the input have
   their summed counts as first sort key (broadcast, at most ``MAX_FREQUENT`` numbers), so a passage
   shared by very many documents is in few prefixes.  Any order is exact; this one keeps buckets small.
3. Rounds: in its buckets, by size, every node follows some node of another component; it is compared with
   the one it follows most often.  Links join components; rounds go on while a fifth of them link.
   Most near copies in large groups link up here, at one comparison per node and round.
4. Then all pairs of nodes not yet connected are compared that share a token of their shortest
   prefixes (m = 1) whose places leave room for the overlap the two sizes need.  Buckets of at most
   ``HOT`` nodes are joined.  Nodes of larger buckets form clusters (connected by such buckets) and size classes, a
   factor of 4/3 each; a class is dealt into blocks, and a cell of two blocks of one class or of
   neighbouring ones is compared inside a task, which hands on links only.

Pairs of steps 3 and 4 are verified on whole texts only after they also share m prefix tokens under
each of the other orders.  A connected component of the links is a group.  Every link is found: a
pair that is never compared is already connected.

Tokens are 64-bit hashes of five words (A-Z lower-cased; fewer words are one token).  Defined
results: null keys come after all others; null, empty and blank texts have an empty set and link with nothing; rows with equal key
and text are one document; an empty table has no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, give_back_memory, slices
from kassa.llm.components import components

SHINGLE, PERCENT, ORDERS, SHARE = 5, 75, 3, 16
#: tokens counted together, how often one must come up among them, and the most of them that are kept
STRETCH, OFTEN, MAX_FREQUENT = 1_000_000, 4, 500_000
#: rows of one token from which on it is put behind rarer ones
LARGE = 24
#: members of one comparison block; the largest bucket whose pairs are joined
BLOCK, HOT = 256, 16
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64."""
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: a number for every byte, the same for a letter and its small form; blanks; powers for a byte's place in its word
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLACE = _odd_powers(0x5851F42D4C957F2D, 256)
_WEIGHTS = np.array([0x9E3779B97F4A7C15 ** (i + 1) & _MASK | 1 for i in range(SHINGLE)], np.uint64)
#: bytes hashed at once (or one text)
_AT_ONCE = 1 << 20


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word."""
    global _PLACE
    inside = ~_BLANK[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    begin = np.flatnonzero(inside & ~before)
    if not len(begin):
        return begin, np.empty(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, begin)
    size = np.diff(np.append(first, len(at)))
    if size.max() > len(_PLACE):
        _PLACE = _odd_powers(int(_PLACE[1]), int(size.max()))
    place = np.arange(len(at)) - np.repeat(first, size)
    return begin, np.add.reduceat(_BYTES[data[at]] * _PLACE[place], first)


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Token sets of the texts data[offsets[i]: offsets[i + 1]]; every text is followed by a blank."""
    begin, h = _word_hashes(data)
    first = np.searchsorted(begin, offsets)
    shingles = np.full(max(len(h) - SHINGLE + 1, 0), SHINGLE, np.uint64)
    for i in range(SHINGLE):
        shingles += h[i: i + len(shingles)] * _WEIGHTS[i]
    shingles = _mix(shingles)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= SHINGLE:
            s = np.sort(shingles[lo: hi - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif n:
            out.append(_mix(np.array([int(sum(int(a) * int(b) for a, b in zip(h[lo:hi], _WEIGHTS)) + n) & _MASK], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def token_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit tokens of every text of a string column."""
    out: list[np.ndarray] = []
    held, size = [], 0

    def flush():
        parts, ends = [], [0]
        for t in held:
            parts += [t, b" "]
            ends.append(ends[-1] + len(t) + 1)
        out.extend(_sets_of(np.frombuffer(b"".join(parts), np.uint8), np.array(ends)))

    for text in texts.cast(pa.binary()).to_pylist():
        held.append(text or b"")
        size += len(held[-1])
        if size >= _AT_ONCE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def token_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a text."""
    return token_sets(pa.array([text], pa.string()))[0]


def signature(tokens: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def common(n: int) -> int:
    """How many prefix tokens a set of n and any larger one must share."""
    return 1 + n // SHARE


def prefix_length(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + common(n))


class Frequent:
    """Counts of tokens that come up often; others count as 0."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        by_name = np.argsort(names)
        self.names, self.counts = names[by_name], counts[by_name]
        self.seen = np.zeros(1 << 22, bool)  # which low bits occur: most tokens need no search
        self.seen[self._low(names)] = True

    def _low(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64(len(self.seen) - 1)).astype(np.int64)

    def count(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        maybe = np.flatnonzero(self.seen[self._low(tokens)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.names, tokens[maybe]), len(self.names) - 1)
            hit = self.names[at] == tokens[maybe]
            out[maybe[hit]] = self.counts[at[hit]]
        return out


def prefix(tokens: np.ndarray, frequent: Frequent, order: int, count: np.ndarray | None = None) -> np.ndarray:
    """The first tokens of a set under one of the global orders: rarer first, then by the order's hash."""
    size = prefix_length(len(tokens))
    key = tokens if order == 0 else _mix(tokens ^ np.uint64(0xD1B54A32D192ED03 * order & _MASK))
    count = frequent.count(tokens) if count is None else count
    rare = np.flatnonzero(count == 0)
    if order:
        few = rare if len(rare) <= size else rare[np.argpartition(key[rare], size - 1)[:size]]
        rare = few[np.argsort(key[few])]
    if len(rare) >= size:
        return tokens[rare[:size]]
    rest = np.flatnonzero(count)
    rest = rest[np.lexsort((key[rest], count[rest]))]
    return tokens[np.concatenate([rare, rest])[:size]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint64).view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its set's size and class; besides, counts of tokens that come up often in a stretch."""
    held, size = [], 0

    def counted():
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= OFTEN
        return pa.RecordBatch.from_arrays(
            [pa.nulls(int(often.sum()), pa.string()), pa.array(counts[often], pa.int64()), pa.array(_signed(names[often]))],
            ["row", "n", "node"])

    for batch in slices(batches):
        sets = token_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([signature(s) if len(s) else None for s in sets], pa.int64())], ["row", "n", "node"])
        for s in sets:
            held.append(s)
            size += len(s)
            if size >= STRETCH:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()
        held = []
    give_back_memory()


def _frequent(counted: DataFrame) -> Frequent:
    """Of (node, n) at most MAX_FREQUENT tokens, the most frequent."""
    top = (counted.groupBy("node").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "node").limit(MAX_FREQUENT).toPandas())
    return Frequent(top["node"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))


def _refined(prefixes: DataFrame, frequent: Frequent) -> Frequent:
    """``frequent`` with the tokens whose bucket would be large, counted exactly over all prefixes."""
    large = (prefixes.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE)
             .orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas())
    counts = pd.Series(frequent.counts, index=_signed(frequent.names))
    counts = pd.concat([counts, pd.Series(large["n"].to_numpy(np.int64), index=large["token"].to_numpy(np.int64))])
    counts = counts.groupby(level=0).max().nlargest(MAX_FREQUENT)
    return Frequent(counts.index.to_numpy(np.int64).view(np.uint64), counts.to_numpy(np.int64))


def _prefix_rows(rows: DataFrame, frequent: Frequent) -> DataFrame:
    """(token, node, n, place) of every row's prefix under the first order.

    ``place`` is in units of n / 256, rounded down, and travels in one number with n.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        for b in slices(batches):
            tokens, nodes, sizes = [np.empty(0, np.uint64)], [], []
            for s in token_sets(b.column("text")):
                if len(s):
                    tokens.append(prefix(s, shared.value, 0))
                    nodes.append(signature(s))
                    sizes.append(len(s))
            times = np.array([len(t) for t in tokens[1:]], np.int64)
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            n = np.repeat(np.array(sizes, np.int64), times)
            yield pa.RecordBatch.from_pydict({
                "token": _signed(np.concatenate(tokens)), "node": np.repeat(np.array(nodes, np.int64), times),
                "size": n * 256 + place * 256 // np.maximum(n, 1)})
        give_back_memory()
    return rows.select("text").mapInArrow(emit, "token long, node long, size long")


def _near_in_size(small: str, large: str) -> str:
    return f"100 * {small} >= {PERCENT} * {large}"


def _common(n: str) -> str:
    return f"1 + {n} div {SHARE}"


def _strong(buckets: DataFrame) -> DataFrame:
    """The rows of nodes that share enough with all others together, the smallest possible partner in mind."""
    n = "(size div 256)"
    enough = buckets.groupBy("node", F.expr(n).alias("n")).agg(F.count("*").alias("k")).where(
        f"k >= {_common(f'(n * {PERCENT} div 100)')}").select(F.col("node").alias("strong"))
    return buckets.join(enough, F.col("node") == F.col("strong"), "left_semi").select("token", "node", "size")


def _buckets(prefixes: DataFrame) -> DataFrame:
    """(token, node, size): rows whose token has another node near in size.

    Of all sizes the neighbour's is the nearest, so looking at both neighbours finds every such row.
    """
    order = "OVER (PARTITION BY token ORDER BY size div 256, node)"
    once = prefixes.selectExpr("token", "node", "size", f"lag(node) {order} AS same").where("same IS NULL OR same <> node")
    both = once.selectExpr("token", "node", "size", "size div 256 AS n", f"lag(size div 256) {order} AS n0", f"lead(size div 256) {order} AS n1")
    near = both.where(f"coalesce({_near_in_size('n0', 'n')}, false) OR {_near_in_size('n', 'n1')}")
    return near.select("token", "node", "size")


def _open(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(token, node, n, place, root): the buckets that hold several components."""
    at = "OVER (PARTITION BY token)"
    labelled = buckets if roots is None else buckets.drop("root").join(
        roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(
        "token", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    return labelled.selectExpr("*", f"min(root) {at} AS r0", f"max(root) {at} AS r1").where("r0 < r1").select(
        "token", "node", "n", "place", "root")


def _nearest(open_: DataFrame, compared: DataFrame | None) -> DataFrame:
    """(a, b): each node b with the node of another component near in size that it most often follows."""
    order = "OVER (PARTITION BY token ORDER BY n, node)"
    before = open_.selectExpr("token", "node", "n", "root", f"lag(root) {order} AS r0",
                              f"lag(struct(n, node)) {order} AS p")
    # inside a run of one component, what stood before the run
    run = "OVER (PARTITION BY token ORDER BY n, node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    follows = before.selectExpr("node", "n", f"last(CASE WHEN r0 <> root THEN p END, true) {run} AS p")
    pairs = follows.where(f"p IS NOT NULL AND {_near_in_size('p.n', 'n')}").groupBy(
        F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("k"))
    if compared is not None:
        pairs = pairs.join(compared, ["a", "b"], "left_anti")
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a")).select("a", "b")


def _unconnected(open_: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components that share a bucket whose places leave room."""
    other = open_.select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("n").alias("nb"),
                         F.col("place").alias("pb"), F.col("root").alias("other"))
    apart = (F.col("token") == F.col("t")) & (F.col("root") != F.col("other")) & (
        (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("node") < F.col("b")))) & F.expr(_near_in_size("n", "nb"))
    # overlap needed: PERCENT (n + nb) / (100 + PERCENT); a pair's first common token has all of it behind it
    room = F.expr(f"{100 + PERCENT} * least(n * (256 - place), nb * (256 - pb)) >= {256 * PERCENT} * (n + nb)")
    return open_.join(other, apart & room).select(F.col("node").alias("a"), "b").distinct()


def _shared(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens every two of the sets have in common."""
    out = np.zeros((len(tokens), len(tokens)), np.float32)
    of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    names, column = np.unique(np.concatenate(tokens), return_inverse=True)
    common_ = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[common_] = np.arange(len(common_))
    of, column = of[place[column] >= 0], place[column][place[column] >= 0]
    for at in range(0, len(common_), 4096):
        some = (column >= at) & (column < at + 4096)
        m = np.zeros((len(tokens), min(4096, len(common_) - at)), np.float32)
        m[of[some], column[some] - at] = 1
        out += m @ m.T
    return out


def _cells(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the links between different components in every cell."""
    cell, held = None, []

    def links():
        roots, sets = np.array([h[1] for h in held]), [h[2] for h in held]
        n = np.array([len(x) for x in sets])
        need = np.array([common(x) for x in n])
        pairs = (roots[:, None] != roots) & (100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n))
        counts = [frequent.count(x) for x in sets]
        for order in range(ORDERS):
            if pairs.any():
                both = _shared([prefix(x, frequent, order, c) for x, c in zip(sets, counts)])
                pairs &= both >= np.minimum(need[:, None], need)
        of, found = {r: r for r in roots.tolist()}, []

        def component(r):
            while of[r] != r:
                of[r] = r = of[of[r]]
            return r

        for i, j in zip(*np.nonzero(np.triu(pairs, 1))):
            a, b = component(held[i][1]), component(held[j][1])
            if a != b and linked(sets[i], sets[j]):
                of[a] = b
                found.append((held[i][0], held[j][0]))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    for batch in slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "root")))
        for (c, node, root), tokens in zip(rows, token_sets(batch.column("text"))):
            if c != cell:
                if len(held) > 1:
                    yield links()
                cell, held = c, []
            held.append((node, root, tokens))
    if len(held) > 1:
        yield links()
    held = []
    give_back_memory()


def _linked_in_cells(scratch: Scratch, hot: DataFrame, texts: DataFrame, frequent: Frequent) -> DataFrame:
    """The links between different components among nodes that share large buckets."""
    # every node of a bucket with its least one: buckets that share nodes are one cluster
    least = hot.groupBy("token").agg(F.min("node").alias("least"))
    clusters = components(scratch, hot.join(least, "token").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    nodes = hot.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"))
    nodes = nodes.join(clusters.select(F.col("node").alias("m"), F.col("root").alias("cluster")), F.col("node") == F.col("m")).select(
        "node", "root", "cluster", size_class.alias("c"))
    blocks = nodes.groupBy("cluster", "c").agg(F.ceil(F.count("*") / BLOCK).alias("own"))
    before = blocks.select(F.col("cluster").alias("k0"), (F.col("c") + 1).alias("c0"), F.col("own").alias("below"))
    after = blocks.select(F.col("cluster").alias("k1"), (F.col("c") - 1).alias("c1"), F.col("own").alias("above"))
    blocks = (blocks.join(before, (F.col("cluster") == F.col("k0")) & (F.col("c") == F.col("c0")), "left")
              .join(after, (F.col("cluster") == F.col("k1")) & (F.col("c") == F.col("c1")), "left")
              .select(F.col("cluster").alias("k"), F.col("c").alias("cc"), "own", F.coalesce("below", F.lit(0)).alias("below"),
                      F.coalesce("above", F.lit(0)).alias("above")))
    block = F.pmod(F.xxhash64("node"), F.col("own"))

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))

    # a cell: cluster, class of its first block, that block, whether the second is of the next class, and its number
    own = F.transform(numbers(F.col("own")), lambda j: F.struct(
        F.col("c").alias("c"), F.least(block, j).alias("i"), F.lit(0).alias("next"), F.greatest(block, j).alias("j")))
    above = F.transform(numbers(F.col("above")), lambda j: F.struct(F.col("c").alias("c"), block.alias("i"), F.lit(1).alias("next"), j.alias("j")))
    below = F.transform(numbers(F.col("below")), lambda i: F.struct(
        (F.col("c") - 1).alias("c"), i.alias("i"), F.lit(1).alias("next"), block.alias("j")))
    dealt = nodes.join(blocks, (F.col("cluster") == F.col("k")) & (F.col("c") == F.col("cc"))).select(
        "node", "root", "cluster", F.explode(F.concat(own, above, below)).alias("cell"))
    dealt = dealt.select("node", "root", F.concat_ws(":", "cluster", "cell.c", "cell.i", "cell.next", "cell.j").alias("cell"))
    shared = hot.sparkSession.sparkContext.broadcast(frequent)
    rows = dealt.join(texts.select(F.col("node").alias("of"), "text"), F.col("node") == F.col("of")).select("cell", "node", "root", "text")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        lambda batches: _cells(batches, shared.value), "a long, b long")


def _other_orders(texts: DataFrame, frequent) -> DataFrame:
    """(node, n, p1, p2, ...): prefixes under the other orders."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = [f"p{k}" for k in range(1, ORDERS)]

    def emit(batches):
        for b in slices(batches):
            sets = token_sets(b.column("text"))
            counts = [shared.value.count(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "n": pa.array([len(s) for s in sets], pa.int32())} | {
                f"p{k}": pa.array([_signed(prefix(s, shared.value, k, c)) for s, c in zip(sets, counts)], pa.list_(pa.int64()))
                for k in range(1, ORDERS)})
    return texts.mapInArrow(emit, "node long, n int, " + ", ".join(f"{p} array<long>" for p in names))


def _in_all_orders(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens under every other order."""
    names = [f"p{k}" for k in range(1, ORDERS)]
    left = orders.select(F.col("node").alias("na"), F.col("n").alias("sa"), *[F.col(c).alias(f"{c}a") for c in names])
    right = orders.select(F.col("node").alias("nb"), F.col("n").alias("sb"), *[F.col(c).alias(f"{c}b") for c in names])
    both = pairs.join(left, pairs["a"] == left["na"]).join(right, pairs["b"] == right["nb"])
    for c in names:
        both = both.where(F.expr(f"size(array_intersect({c}a, {c}b)) >= {_common('least(sa, sb)')}"))
    return both.select("a", "b")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, block), each block's head before its members: the linked pairs."""
    at, head = None, np.empty(0, np.uint64)
    for batch in slices(batches):
        hits_a, hits_b = [], []
        places = zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b")))
        for (a, block, b), tokens in zip(places, token_sets(batch.column("text"))):
            if b == a:
                if at != (a, block):
                    at, head = (a, block), tokens
            elif linked(head, tokens):
                hits_a.append(a)
                hits_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(hits_a, pa.int64()), pa.array(hits_b, pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links.  Texts of b travel to blocks of about BLOCK per a."""
    texts = texts.select(F.col("node").alias("of"), "text")
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("a", "head")
    members = pairs.join(size, pairs["a"] == size["head"]).select(
        "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    heads = size.select(F.col("head").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                        F.col("head").alias("b"))
    rows = members.unionByName(heads).join(texts, F.col("b") == F.col("of")).select(
        "a", "block", "b", (F.col("a") != F.col("b")).alias("member"), "text")
    return (rows.repartition("a", "block").sortWithinPartitions("a", "block", "member")
            .select("a", "block", "b", "text").mapInArrow(_compare, "a long, b long"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n, component): per row its key, its text's hash, set size, least key of its group."""
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    rows = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    kind = rows.schema["id"].dataType
    # keys pass through as text: a nullable number would become a float on the way
    surveyed = scratch.settle(rows.select(F.struct("id", "h").alias("r"), "text").select(
        F.to_json(F.struct(F.col("r.id").cast("string").alias("id"), F.col("r.h").cast("string").alias("h"))).alias("row"), "text")
        .mapInArrow(_survey, "row string, n long, node long"), "survey")
    keys = F.from_json("row", "id string, h string")
    sets = surveyed.where("row IS NOT NULL").withColumn("k", keys).select(
        F.col("k.id").cast(kind).alias("id"), F.col("k.h").cast("long").alias("h"), "n", "node")
    frequent = _frequent(surveyed.where("row IS NULL").select("node", "n"))

    # what short stretches miss shows in the size of its bucket
    frequent = _refined(_prefix_rows(rows, frequent).select("token"), frequent)
    scratch.release()

    # a token's nodes stand together after one shuffle; tokens without a pair near in size go
    buckets = scratch.settle(_buckets(_prefix_rows(rows, frequent)), "buckets")
    scratch.release()
    weak = buckets
    buckets = scratch.settle(_buckets(_strong(weak)), "strong")
    scratch.drop(weak)
    scratch.release()

    # whole texts of the nodes in buckets, one row of documents each
    named = sets.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("id", "h")).alias("first"), F.min("id").alias("id"))
    wanted = buckets.select(F.col("node").alias("wanted")).distinct().join(named, F.col("wanted") == F.col("node")).select(
        "node", F.col("first.id").alias("wid"), F.col("first.h").alias("wh"))
    texts = scratch.settle(
        rows.join(wanted, (F.col("h") == F.col("wh")) & F.col("id").eqNullSafe(F.col("wid"))).select("node", "text"), "texts")
    orders = scratch.settle(_other_orders(texts, frequent), "orders")
    scratch.release()

    links = compared = roots = None
    open_ = buckets.select("token", "node", F.expr("size div 256").alias("n"), F.expr("size % 256").cast("int").alias("place"),
                           F.col("node").alias("root"))
    first = open_
    while True:
        nearest = scratch.settle(_nearest(open_, compared), "nearest")
        found = scratch.settle(_verified(scratch.settle(_in_all_orders(nearest, orders), "pairs"), texts), "links")
        scratch.release()
        links = found if links is None else links.unionByName(found)
        compared = nearest if compared is None else compared.unionByName(nearest)
        n_found = found.count()
        if n_found:
            roots = components(scratch, links)
        # what is connected stays connected, so the next table comes from this one
        before, open_ = open_, scratch.settle(_open(open_, roots), "open")
        scratch.drop(buckets if before is first else before)
        scratch.release()
        if 5 * n_found <= nearest.count():
            break
    shortest = open_.where(f"100 * (256 - place) >= {256 * PERCENT}").withColumn(
        "k", F.expr("count(*) OVER (PARTITION BY token)")).where("k > 1")
    shortest = scratch.settle(shortest, "shortest")
    scratch.drop(open_)
    scratch.release()
    pairs = _unconnected(shortest.where(F.col("k") <= HOT)).join(compared, ["a", "b"], "left_anti")
    found = scratch.settle(_verified(scratch.settle(_in_all_orders(pairs, orders), "open-pairs"), texts), "links")
    in_cells = scratch.settle(_linked_in_cells(scratch, shortest.where(F.col("k") > HOT), texts, frequent), "cell-links")
    found = found.unionByName(in_cells)
    scratch.release()

    roots = components(scratch, links.unionByName(found))
    part = named.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(
        "node", F.coalesce("root", "node").alias("root"), "id")
    least = part.groupBy("root").agg(F.min("id").alias("component"))
    part = part.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(
        F.col("node").alias("of"), "component")
    return sets.join(part, F.col("node") == F.col("of"), "left").select(
        "id", "h", "n", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have the least key of their group, with their own columns.

    Of rows equal in key and text one stays.
    """
    kept = groups(docs, key, text).where(F.col("id").eqNullSafe(F.col("component"))).select("id", "h").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(kept, F.col(f"row.{key}").eqNullSafe(F.col("id")) & (F.xxhash64(f"row.{text}") == F.col("h")), "left_semi")
    return rows.select("row.*")
