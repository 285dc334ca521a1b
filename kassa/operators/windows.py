"""Window operators (W1-W11) as standalone operators.

Per-key row-order windows go through kassa.operators.sequence (bounded partitions
for hot keys).  W9/W10 run over daily series: one row per series and day, so a
series partition is bounded by the calendar span.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kassa.functions.calendar import whole_days_between
from kassa.operators import sequence as seq
from kassa.operators.features import ROLLING_HALO, monthly_aggregates, monthly_derived, monthly_stats, rolling_frames


def rolling_stats(df: DataFrame, keys: list[str], value: str = "amount_abs",
                  chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W1-W4 (value = amount_abs) / W11 (value = amount): 7/30-row mean and sample std."""
    s = seq.sequence(df, keys, frames=rolling_frames(value), halo=ROLLING_HALO, chunk_rows=chunk_rows)
    return s.drop(seq.RANK, seq.DAY_RANK, seq.PREV_TS)


def days_since_last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Floor of elapsed days since the key's previous row; first row 0."""
    s = seq.sequence(df, keys)
    return (s.withColumn("days_since_last",
                         F.coalesce(whole_days_between(F.col("date"), F.col(seq.PREV_TS)), F.lit(0)))
            .drop(seq.RANK, seq.DAY_RANK, seq.PREV_TS))


def count_in_last_days(df: DataFrame, keys: list[str], days: int = 7, name: str = "transaction_count_7d") -> DataFrame:
    """Rows in (t - days, t], later rows with equal t excluded."""
    return seq.sequence(df, keys, lookback_days=days, count_name=name).drop(seq.RANK, seq.DAY_RANK, seq.PREV_TS)


def same_day_rank(df: DataFrame, keys: list[str], name: str = "transaction_count_7d") -> DataFrame:
    """Running count within the calendar day (serving variant of the 7-day count)."""
    return seq.sequence(df, keys).withColumn(name, F.col(seq.DAY_RANK)).drop(seq.RANK, seq.DAY_RANK, seq.PREV_TS)


def monthly_transform(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per-(keys, month) aggregates attached to every row (aggregate + join)."""
    m = monthly_stats(df, keys)
    return df.withColumn("year_month", F.date_format("date", "yyyy-MM")).join(m, [*keys, "year_month"], "left")


def monthly_inside_buckets(df: DataFrame, keys: list[str]) -> DataFrame:
    """W8/J2 on a table bucketed by a key of ``keys``: windows per (keys, month), without an exchange."""
    w = Window.partitionBy(*keys, "year_month")
    rows = df.withColumn("year_month", F.date_format("date", "yyyy-MM"))
    return rows.withColumns({c: e.over(w) for c, e in monthly_aggregates().items()}).withColumns(monthly_derived())


def last_k(daily: DataFrame, series: list[str], k: int, order: str = "ds") -> DataFrame:
    """The last k rows of each series (by ``order``)."""
    w = Window.partitionBy(*series).orderBy(F.col(order).desc())
    return daily.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
