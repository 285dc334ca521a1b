"""File sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.operators.clean import map_na_tokens, parse_timestamp
from kassa.sources import typed_csv


def load_transactions(spark: SparkSession, path: str, schema=None, date_formats: list[str] | None = None,
                      infer: bool = True, multiline: bool = False) -> DataFrame:
    """Header CSV.  Columns get the types of ``schema``, else those their values fit (one more scan, see
    ``typed_csv``), or stay text with ``infer=False``; NA tokens become null.  ``date`` is parsed from its
    text when present, in all layouts that cleaning knows."""
    texts = typed_csv.read_texts(spark, path, multiline)
    date = next((c for c in texts.columns if c.strip().lower() == "date"), None)
    if isinstance(schema, str):
        schema = typed_csv.T._parse_datatype_string(schema)
    if schema is None and infer:
        schema = typed_csv.schema_of(texts.drop(date) if date else texts)
    df = map_na_tokens(texts)
    if date:
        df = df.withColumn(date, parse_timestamp(F.col(f"`{date}`"), date_formats))
    to = {f.name: f.dataType for f in schema.fields if f.name != date} if schema is not None else {}
    return df.select(*[typed_csv.parse(F.col(f"`{c}`"), to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Parquet by default, typed CSV when the path says so."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        return load_transactions(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def indexed_metrics(df: DataFrame, index: str | None = None, target: str = "target") -> DataFrame:
    """First column is the row index (kept as a key), the rest numeric; drop ``target``."""
    index = index or df.columns[0]
    out = df.drop(target) if target in df.columns else df
    return out.withColumnRenamed(index, "row_id") if index != "row_id" else out


def newest_root(spark: SparkSession, pattern: str) -> str | None:
    """The newest of the snapshots (files or folders) matching ``pattern``.

    A snapshot is as new as its newest file; equal times go to the greater path.  Only
    names and times are listed, one entry per snapshot file, and nothing is read.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    best = None
    for root in fs.globStatus(path) or []:
        times = [f.getModificationTime() for f in fs.listStatus(root.getPath())
                 if not f.getPath().getName().startswith(("_", "."))] if root.isDirectory() else [root.getModificationTime()]
        if times:
            best = max(best or (-1, ""), (max(times), root.getPath().toString()))
    return best[1] if best else None


def latest_snapshot(spark: SparkSession, pattern: str, fmt: str = "csv", schema=None) -> DataFrame:
    """S3: of the snapshots matching ``pattern`` the newest one, whole; older ones are not read."""
    root = newest_root(spark, pattern)
    if root is None:
        raise FileNotFoundError(f"no snapshot matches {pattern}")
    return read_table(spark, root, fmt, schema)
