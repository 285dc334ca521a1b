"""Sinks (S7-S11).  Every sink is a distributed write; nothing passes through the driver."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.operators.anomaly import top_anomalies
from kassa.operators.filters import drop_prefix
from kassa.sources.typed_csv import FORMAT

# times with all their digits; null and the empty text are both an empty field, as in pandas
CSV_FORMAT = FORMAT | {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "emptyValue": ""}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Clean / featured / predicted tables (CSV gets a header)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_FORMAT)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_with_review(df: DataFrame, path: str, review_path: str | None = None, fmt: str = "parquet") -> bool:
    """All rows, plus the review rows in a second table only when there are any.

    The input is persisted so the two writes and the emptiness probe share one
    computation.  Returns whether the review table was written."""
    df = df.persist()
    try:
        write_table(df, path, fmt)
        review = df.filter(F.col("needs_review"))
        if review_path and not review.isEmpty():
            write_table(review, review_path, fmt)
            return True
        return False
    finally:
        df.unpersist()


def export_path(prefix: str, now: dt.datetime | None = None) -> str:
    """S9 file name: ``<prefix>_YYYYmmdd_HHMMSS``."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return f"{prefix}_{now.strftime('%Y%m%d_%H%M%S')}"


def export(df: DataFrame, prefix: str, include_probabilities: bool = False, review_only: bool = False,
           fmt: str = "csv", now: dt.datetime | None = None) -> str:
    """Drop prob_* unless asked, optionally review rows only, timestamped name."""
    out = df if include_probabilities else drop_prefix(df)
    if review_only:
        out = out.filter(F.col("needs_review"))
    return write_table(out, export_path(prefix, now), fmt)


def write_anomalies(scored: DataFrame, path: str, top_path: str | None = None, n: int = 10, fmt: str = "parquet") -> str:
    """One write, partitioned by the flag (``is_anomaly=true`` is the suspicious subset), and
    the ``n`` largest errors as a table of their own."""
    write_table(scored, path, fmt, partition_by=["is_anomaly"])
    if top_path:
        back = scored.sparkSession.read.format(fmt).load(path).withColumn("is_anomaly", F.col("is_anomaly").cast("boolean"))
        write_table(top_anomalies(back, n), top_path, fmt)
    return path


def write_forecasts(forecast: DataFrame, path: str, total: DataFrame | None = None, fmt: str = "parquet") -> str:
    """One folder per category (partitionBy), written by all tasks in parallel; the total
    series goes to a folder beside it."""
    write_table(forecast, f"{path}/categories", fmt, partition_by=["category"])
    if total is not None:
        write_table(total, f"{path}/total", fmt)
    return path


def write_dashboards(rows: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Dashboard rows of several horizons, one folder per horizon."""
    return write_table(rows, path, fmt, partition_by=["horizon_days"])
