"""Per-key row order without one task per key.

The reference computes its rolling features over one sorted file.  Here they are per
key (``user_id``), and a single key may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would put that key into one task.  Instead:

1. **Range parts.**  Rows are range-partitioned by (key, time, tiebreak), sorted, numbered and
   written; a part is a stretch of at most ``chunk_rows`` consecutive rows of one partition.  A
   key with half of all rows, on one day or not, spreads over half of the parts.  All windows
   run inside ``(key, part)``, so they share one exchange and one sort.
2. **Carries.**  Only a key that reaches over a part's border needs anything from elsewhere, and
   a part has two borders.  If all of the key's rows fit one part they are counted to its first one;
   for longer keys, (key, part, day) counts give what precedes each
   part: rows, rows of the same day, the running sum of 3.  That table has at most two rows
   per part and is broadcast.
3. **Look-back counts.**  The "rows in (t - L, t]" count is a running sum over the
   key's sequence in which every row adds +1 at ``t`` and a probe subtracts 1 at
   ``t + L`` (probes sort before rows with the same time, so a row exactly L old is
   out).  Sums carry over like counts, so no range join is needed.
4. **Border rows.**  Row-count windows (last n rows) need up to n - 1 rows from before a part.
   The last rows of each such key in each part, at most ``halo`` of them, are passed to the next part as
   read-only context: a small table that joins the rows before their exchange, not a
   second shuffle of all rows.
5. **Groups.**  Aggregates per key and a column of the time (its month) are windows inside
   the part too; for keys that reach over a border they come from an aggregate over those keys.

No unit of work grows with the rows of a key or of a day.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from kassa.session import ensure_checkpoint_dir, materialise

DEFAULT_CHUNK_ROWS = 1 << 20

RANK = "_rank"          # 1-based position in (ts, tiebreak) order within the key
DAY_RANK = "_day_rank"  # 1-based position within (key, calendar day)
PREV_TS = "_prev_ts"    # timestamp of the previous row of the key (null for the first)


def _group_columns(df: DataFrame, keys: list[str]) -> dict[str, Column]:
    """Null-safe stand-ins for the key columns: a nullable key becomes a non-null value
    plus an is-null flag, so that windows and joins use plain equality.  Without keys all rows
    are one group.
    """
    out: dict[str, Column] = {} if keys else {"_g0": F.lit(0)}
    for i, f in enumerate(df.schema[k] for k in keys):
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            out[f"_g{i}"] = c
            continue
        if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)):
            out[f"_g{i}"] = F.coalesce(c, F.lit(0).cast(f.dataType))
        else:
            out[f"_g{i}"] = F.coalesce(c.cast("string"), F.lit(""))
        out[f"_g{i}n"] = c.isNull()
    return out


def _parts(df: DataFrame, gcols: dict[str, Column], keys: list[str], ts: str, tiebreak: str,
           lookback_days: int | None, chunk_rows: int) -> DataFrame:
    """Rows (kind 1) and probes (kind 0), written in order with ``_mid`` (place) and ``_part``."""
    # one pass over the input: every row is emitted as itself and, for the look-back
    # count, once more as a probe that carries only the key columns
    kinds = F.array(F.lit(1), F.lit(0)) if lookback_days is not None else F.array(F.lit(1))
    gen = df.withColumns(gcols).withColumn("_kind", F.explode(kinds))
    is_row = F.col("_kind") == 1
    t = F.col(ts)
    if lookback_days is not None:
        t = F.when(is_row, t).otherwise(t + F.make_dt_interval(days=F.lit(lookback_days)))
    u = gen.select(
        *[F.col(f"`{f.name}`") if f.name in keys else F.when(is_row, F.col(f"`{f.name}`")).alias(f.name)
          for f in df.schema.fields],
        *[F.col(c) for c in gcols if c not in df.columns],
        t.alias("_t"), "_kind",
        F.when(F.col(ts).isNull(), F.lit(0)).when(is_row, F.lit(1)).otherwise(F.lit(-1)).alias("_w"))
    # undated rows stand before all others, on a day of their own
    u = u.withColumn("_slot", F.coalesce(F.to_date("_t"), F.lit("0001-01-01").cast("date")))
    # probes sort before rows at equal time
    order = [*gcols, "_t", "_kind", tiebreak]
    ordered = u.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    # the id is a partition's number and a place in it; written, so that both stay when a task runs again
    pid, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftleft(pid, 33) + F.floor(place / chunk_rows)
    return materialise(ordered.withColumn("_part", part.cast("long")), "sequence")


def _reaching(u: DataFrame, g: list[str]) -> DataFrame:
    """Keys with rows in more than one part (first or last key of at least two, so at most one per
    part), with their number of rows and their first part."""
    ends = u.groupBy("_part").agg(F.min(F.struct(*g)).alias("lo"), F.max(F.struct(*g)).alias("hi"))
    ends = ends.select("_part", F.explode(F.array("lo", "hi")).alias("k"))
    keys = ends.groupBy("k").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).where("a < b").select("k.*")
    counts = u.join(F.broadcast(keys), g).groupBy(*g).agg(F.count(F.lit(1)).alias("_rows"), F.min("_part").alias("_home"))
    return materialise(counts, "reaching_keys")


def _carries(reaching: DataFrame, g: list[str]) -> DataFrame:
    """Per (key, part): what precedes the part.  ``reaching`` holds the rows of keys in several parts."""
    hist = (reaching.groupBy(*g, "_part", "_slot").agg(F.sum("_kind").alias("_n"), F.sum("_w").alias("_ws")))
    before = Window.partitionBy(*g).orderBy("_part", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*g, "_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*g, "_part").orderBy("_slot")
    hist = hist.select(*g, "_part", F.col("_slot").alias("_first_slot"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
                       F.coalesce(F.sum("_ws").over(before), F.lit(0)).alias("_w_before"),
                       F.coalesce(F.sum("_n").over(same), F.lit(0)).alias("_n_same_day"),
                       F.row_number().over(first).alias("_i"))
    return hist.where("_i = 1").drop("_i")


def _border_rows(reaching: DataFrame, g: list[str], halo: int) -> DataFrame:
    """For every part that continues a key, the key's last ``halo`` rows before it, with that part's number."""
    rows = reaching.where("_kind = 1")
    last = Window.partitionBy(*g, "_part").orderBy(F.col("_mid").desc())
    tail = rows.withColumn("_i", F.row_number().over(last)).where(F.col("_i") <= halo)
    # of each part's last rows, the last ones up to a part's end are the key's last ones there
    along = Window.partitionBy(*g).orderBy("_mid")
    held = F.collect_list(F.struct(*rows.columns)).over(along.rowsBetween(1 - halo, 0))
    ends = tail.withColumn("_held", held).where("_i = 1").withColumn("_next", F.lead("_part").over(along))
    out = ends.where("_next IS NOT NULL").select("_next", F.explode("_held").alias("_r")).select("_next", "_r.*")
    return out.withColumn("_part", F.col("_next")).drop("_next")


def sequence(df: DataFrame, keys: list[str], ts: str = "date", tiebreak: str = "transaction_id",
             lookback_days: int | None = None, count_name: str = "count_lookback",
             attach: tuple[DataFrame, dict[str, Column]] | None = None,
             frames: dict[str, Callable[[WindowSpec], Column]] | None = None, halo: int = 0,
             groups: tuple[Column, dict[str, Column]] | None = None,
             chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add RANK, DAY_RANK, PREV_TS and, if ``lookback_days``, ``count_name``.

    ``count_name`` = number of rows j of the key with position <= i and
    ts_j > ts_i - lookback (pandas ``rolling('7D').count()`` on a sorted index).
    Call this on a narrow frame: every column travels through the sort.

    ``frames``: further columns, each a function of the key's window in order, which may look
    back up to ``halo`` rows.  ``groups = (by, columns)``: aggregates per key and ``by``, an expression
    over ``ts``.

    Rows without a timestamp come first in their key's order, have no look-back count
    (null) and count in nobody else's.

    ``attach = (table, derived)``: a table keyed by ``keys`` plus the columns named in
    ``derived`` (expressions over the day column ``_day``, e.g. its month), left-joined
    to every row.
    """
    keys, frames = list(keys), frames or {}
    if halo >= chunk_rows:
        raise ValueError("halo must be smaller than chunk_rows")
    gcols = _group_columns(df, keys)
    g = list(gcols)
    u = _parts(df, gcols, keys, ts, tiebreak, lookback_days, chunk_rows)
    reaching_keys = _reaching(u, g)
    longest = reaching_keys.agg(F.max("_rows")).first()[0] or 0
    u = u.withColumn("_own", F.lit(True))
    if longest:
        # a key that fits one part goes to one (at most one key per part: a bounded broadcast)
        fitting = F.broadcast(reaching_keys.where(F.col("_rows") <= chunk_rows).drop("_rows"))
        u = u.join(fitting, g, "left").withColumn("_part", F.coalesce("_home", "_part")).drop("_home")
    carry: list[str] = []
    across = longest > chunk_rows
    if across:
        reaching = u.join(F.broadcast(reaching_keys.where(F.col("_rows") > chunk_rows)), g, "left_semi")
        carries = _carries(reaching, g)
        if halo:
            u = u.unionByName(_border_rows(reaching, g, halo).withColumns(
                {"_own": F.lit(False), "_w": F.lit(0).cast(u.schema["_w"].dataType)}))

    w = Window.partitionBy(*g, "_part").orderBy("_slot", "_mid")
    w_day = Window.partitionBy(*g, "_part", "_slot").orderBy("_mid")
    run = (Window.unboundedPreceding, Window.currentRow)
    counted = F.when(F.col("_own"), F.col("_kind")).otherwise(0)
    rows = u.select(
        "*",
        F.sum(counted).over(w.rowsBetween(*run)).alias("_in_rank"),
        F.sum("_w").over(w.rowsBetween(*run)).alias("_in_w"),
        F.last(F.when(F.col("_kind") == 1, F.col("_t")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_prev"),
        F.sum(counted).over(w_day.rowsBetween(*run)).alias("_in_day"),
    ).where("_kind = 1")
    # the same partitions in the same order, without the probes
    rows = rows.withColumns({name: frame(w) for name, frame in frames.items()}).where("_own")
    if across:
        # at most two rows per part
        rows = rows.join(F.broadcast(carries), [*g, "_part"], "left")
        carry = ["_n_before", "_w_before", "_n_same_day", "_first_slot"]
        if not halo:
            last = _previous_times(reaching, g)
            rows = rows.join(F.broadcast(last), [*g, "_part"], "left")
            rows = rows.withColumn("_in_prev", F.coalesce("_in_prev", "_before_t")).drop("_before_t")

    def carried(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if carry else F.lit(0)

    same_day = F.when(F.col("_slot") == F.col("_first_slot"), carried("_n_same_day")).otherwise(0) if carry else F.lit(0)
    extra = {
        RANK: (carried("_n_before") + F.col("_in_rank")).cast("long"),
        DAY_RANK: (same_day + F.col("_in_day")).cast("long"),
        PREV_TS: F.col("_in_prev"),
    }
    if lookback_days is not None:
        extra[count_name] = F.when(F.col(ts).isNotNull(), carried("_w_before") + F.col("_in_w")).cast("long")
    added: list[str] = []
    if groups is not None:
        by, aggregates = groups
        added = list(aggregates)
        rows = rows.withColumn("_by", by)
        inside = Window.partitionBy(*g, "_part", "_by")
        rows = rows.withColumns({c: e.over(inside) for c, e in aggregates.items()})
        if across:
            whole = reaching.where("_kind = 1").withColumn("_by", by).groupBy(*g, "_by").agg(
                F.lit(True).alias("_across"), *[e.alias(f"_all_{c}") for c, e in aggregates.items()])
            # written: the planner sees how few keys these are
            whole = materialise(whole.withColumn("_no_by", F.col("_by").isNull()).withColumn("_by", _never_null(whole, "_by")), "groups")
            rows = rows.withColumn("_no_by", F.col("_by").isNull()).withColumn("_by", _never_null(rows, "_by"))
            rows = rows.join(whole, [*g, "_by", "_no_by"], "left")
            rows = rows.withColumns({c: F.when(F.col("_across"), F.col(f"_all_{c}")).otherwise(F.col(c)) for c in aggregates})
    out = rows.withColumns(extra).select(*df.columns, *extra, *frames, *added)
    if attach is None:
        return out
    table, derived = attach
    out = out.withColumn("_day", F.to_date(ts)).withColumns({f"_hd_{c}": e for c, e in derived.items()})
    same = [out[k].eqNullSafe(table[k]) for k in keys] + [out[f"_hd_{c}"].eqNullSafe(table[c]) for c in derived]
    attached = [c for c in table.columns if c not in keys and c not in derived]
    return out.join(table, reduce(lambda a, b: a & b, same), "left").select(
        *[out[c] for c in [*df.columns, *extra, *frames, *added]], *[table[c] for c in attached])


def _never_null(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _previous_times(reaching: DataFrame, g: list[str]) -> DataFrame:
    """Per (key, part) the last time before the part (``_before_t``)."""
    last = reaching.groupBy(*g, "_part").agg(F.max(F.when(F.col("_kind") == 1, F.col("_t"))).alias("_last"))
    before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*g, "_part", F.max("_last").over(before).alias("_before_t"))


def dense_index(df: DataFrame, order: list, name: str = "_idx") -> DataFrame:
    """1-based dense position of each row in ``order`` (a global order), without a
    global window: a range-partitioned sort, then per-partition counts (one row per
    partition, broadcast) turned into offsets.  The sorted frame is checkpointed to
    the session's checkpoint folder first, so the partition layout the ids depend on
    is fixed even if tasks are re-run on other executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), 33)
    counts = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: this window is bounded by the partition count
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (s.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local + 1).cast("long")).drop("_pid", "_off", "_mid"))
