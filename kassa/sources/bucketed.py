"""Tables bucketed by a key, so that joins, aggregates and windows on it need no exchange.

A bucketed table is written once with its rows hashed by key into ``buckets`` sorted groups of files and is
registered under a name.  Two tables with the same key and number of buckets join bucket by bucket,
and grouping or windows by the key (and anything more) run inside a bucket.  That pays when the same key is joined
again and again; a key that holds a large share of the rows keeps its bucket large, since AQE does not split
bucketed scans: join such a table unbucketed.

The files lie in the session's warehouse (a folder that driver and executors share) unless a path is given.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Writes ``df`` as table ``name`` and returns it as read from there."""
    w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def new_name(prefix: str) -> str:
    """A table name that no other run uses."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forgets the table (and deletes its files unless it was given a path)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
