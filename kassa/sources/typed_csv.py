"""CSV with the types its values have, decided by one aggregate.

Every value of a text column belongs to a *kind*: boolean, long, double, timestamp or text; missing values (the
NA tokens) belong to none.  Kinds form a lattice: long is below double, everything is below text, and two
kinds without an order meet in text.  A column's type is the join of its values' kinds, so one number
per column (the set of kinds seen, as bits) says everything, sets of several files or days are merged by "or",
and one aggregate with partial sums over one scan finds them all.  The data are then read once more, each
column in its type.

Values that look like numbers but would lose digits (whole numbers beyond a long) are text.  A timestamp with a
zone is text, since the ledger's times have none.  A column of missing values only is double, one without rows
is text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.operators.clean import DECIMAL, NA_TOKENS

BOOLEAN, LONG, DOUBLE, TIMESTAMP, TEXT = 1, 2, 4, 8, 16

_BOOLEAN = r"^(?i:true|false)$"
_LONG = r"^\s*[+-]?\d+\s*$"
_INFINITY = r"^[+-]?(?i:inf|infinity)$"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"

_TYPES = {BOOLEAN: T.BooleanType(), LONG: T.LongType(), DOUBLE: T.DoubleType(), LONG | DOUBLE: T.DoubleType(),
          TIMESTAMP: T.TimestampNTZType(), 0: T.DoubleType()}

# RFC 4180, which is what pandas and spreadsheets write; Spark's own default escapes with a backslash and
# trims texts while writing
FORMAT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
          "ignoreTrailingWhiteSpace": "false"}


def na_to_null(x: Column, tokens=NA_TOKENS) -> Column:
    return F.when(~x.isin(*tokens), x)


def parse_double(x: Column) -> Column:
    """A decimal or an infinity, else null."""
    infinite = F.when(F.btrim(x).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(DECIMAL), F.btrim(x).try_cast("double")).when(x.rlike(_INFINITY), infinite)


def parse(x: Column, to: T.DataType) -> Column:
    """A text as ``to``; null where it is missing or no such value."""
    x = na_to_null(x)
    if isinstance(to, T.StringType):
        return x
    if isinstance(to, (T.DoubleType, T.FloatType)):
        return parse_double(x).cast(to)
    if isinstance(to, T.TimestampNTZType):
        return F.when(x.rlike(_TIMESTAMP), x.try_cast(to))
    return F.btrim(x).try_cast(to)


def kind(x: Column) -> Column:
    """The kind of one value, 0 where it is missing."""
    return (F.when(x.isNull() | x.isin(*NA_TOKENS), 0)
            .when(x.rlike(_LONG), F.when(F.btrim(x).try_cast("long").isNotNull(), LONG).otherwise(TEXT))
            .when(parse_double(x).isNotNull(), DOUBLE)
            .when(x.rlike(_TIMESTAMP), F.when(x.try_cast("timestamp_ntz").isNotNull(), TIMESTAMP).otherwise(TEXT))
            .when(x.rlike(_BOOLEAN), BOOLEAN)
            .otherwise(TEXT))


def kinds(df: DataFrame) -> dict[str, int | None]:
    """The set of kinds of every text column (None where the table has no row): one scan, one row back."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    row = df.agg(*[F.bit_or(kind(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(texts)]).first()
    return dict(zip(texts, row))


def merge_kinds(a: dict[str, int | None], b: dict[str, int | None]) -> dict[str, int | None]:
    """Kinds of two tables put together (of the files of two days, for example)."""
    out = dict(a)
    for c, k in b.items():
        out[c] = k if out.get(c) is None else out[c] if k is None else out[c] | k
    return out


def type_of(kinds_seen: int | None) -> T.DataType:
    return T.StringType() if kinds_seen is None else _TYPES.get(kinds_seen, T.StringType())


def read_texts(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file or folder, every column as text; a file whose header differs from the others' is an error
    (columns are read by position)."""
    reader = spark.read.options(**FORMAT).option("mode", "PERMISSIVE").option("multiLine", multiline)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return reader.option("enforceSchema", "false").schema(schema).csv(path)


def schema_of(df: DataFrame, known: dict[str, int | None] | None = None) -> T.StructType:
    """The schema that ``df``'s texts fit, together with ``known`` kinds of earlier files."""
    seen = merge_kinds(known or {}, kinds(df))
    return T.StructType([T.StructField(f.name, type_of(seen[f.name]) if f.name in seen else f.dataType) for f in df.schema.fields])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df``'s columns, each read as its type in ``schema`` (by name; columns not in it stay text)."""
    to = {f.name: f.dataType for f in schema.fields}
    return df.select(*[parse(F.col(f"`{c}`"), to.get(c, T.StringType())).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             known: dict[str, int | None] | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file or folder with typed columns: those of ``schema``, or else those its values fit."""
    texts = read_texts(spark, path, multiline)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return typed(texts, schema if schema is not None else schema_of(texts, known))
