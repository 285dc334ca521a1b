"""Cleaning, validation and profiling."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.functions.text import normalize_text
from kassa.operators.sequence import dense_index

# The columns every ledger must have.
REQUIRED_COLUMNS = ["date", "description", "amount"]

# Layouts tried after ISO, in this order.  Day-first layouts are ambiguous with these and
# have to be asked for.
DATE_FORMATS = ["MM/dd/yyyy", "M/d/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy"]

# A plain decimal number.  Java's own literals ("1d", "0x1p3"), infinities and NaN are not amounts.
DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Tokens a CSV reader should treat as missing (pandas' default NA set).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Lower-case and strip every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def schema_faults(schema: T.StructType, required=REQUIRED_COLUMNS) -> list[tuple[str, str]]:
    """(column, fault) for every required column that is absent, repeated or not a plain value."""
    out = []
    for name in required:
        found = [f.dataType for f in schema.fields if f.name == name]
        if len(found) != 1:
            out.append((name, "absent" if not found else f"occurs {len(found)} times"))
        elif isinstance(found[0], (T.ArrayType, T.MapType, T.StructType)):
            out.append((name, f"is a {found[0].typeName()}"))
    return out


def column_report(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """C2 as rows: column, fault (null when the column is fine), n_values (values it has, 0 with a fault)."""
    faults = dict(schema_faults(df.schema, required))
    fine = [c for c in required if c not in faults]
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(fine)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(faults.get(c)).cast("string").alias("fault"),
                              (F.col(f"n{fine.index(c)}") if c in fine else F.lit(0)).cast("long").alias("n_values"))
                     for c in required])
    return counts.select(F.inline(rows))


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """The frame itself, or a ValueError that names every fault at once (no job)."""
    faults = schema_faults(df.schema, required)
    if faults:
        raise ValueError("unusable ledger: " + "; ".join(f"column {c!r} {why}" for c, why in faults))
    return df


# The shape of a layout's letters; a layout with any other letter is tried on every value.
_SHAPES = {"yyyy": r"\d{4}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}", "MMM": r"\p{L}{3,4}",
           "MMMM": r"\p{L}+", "HH": r"\d{2}", "H": r"\d{1,2}", "mm": r"\d{2}", "ss": r"\d{2}"}
_ISO_SHAPE = r"^\s*[+-]?\d{4,7}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?\s*$"


def layout_shape(fmt: str) -> str | None:
    """A pattern that every text of a date layout matches, from its letters; None if it has others."""
    out = ""
    for letters, _, other in re.findall(r"(([A-Za-z])\2*)|([^A-Za-z])", fmt):
        if letters and letters not in _SHAPES:
            return None
        out += _SHAPES[letters] if letters else re.escape(other)
    return f"^{out}$"


def parse_timestamp(x: Column, formats: list[str] | None = None, source_type: T.DataType | None = None) -> Column:
    """string/timestamp -> timestamp_ntz, unparseable -> null.

    ISO layouts first, then ``formats`` in order (``DATE_FORMATS`` by default).  A layout is only parsed
    where the text has its shape, so a value costs one parse, whatever the number of layouts.
    Values that already are timestamps or dates are cast directly.
    """
    if isinstance(source_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return x.cast("timestamp_ntz")
    s = x.cast("string")
    cands = [F.when(s.rlike(_ISO_SHAPE), s.try_cast("timestamp_ntz"))]
    trimmed = F.btrim(s)
    for fmt in DATE_FORMATS if formats is None else formats:
        parsed, shape = F.try_to_timestamp(trimmed, F.lit(fmt)).cast("timestamp_ntz"), layout_shape(fmt)
        cands.append(parsed if shape is None else F.when(trimmed.rlike(shape), parsed))
    return F.coalesce(*cands)


def coerce_double(x: Column, source_type: T.DataType | None = None) -> Column:
    """To double; text must be a plain decimal.  NaN and infinities become null, since one of
    them would turn every sum it enters into itself."""
    if isinstance(source_type, T.NumericType):
        d = x.cast("double")
    else:
        d = F.when(x.cast("string").rlike(DECIMAL), F.btrim(x.cast("string")).try_cast("double"))
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def dropped_counts(df: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """Why cleaning drops rows: how many have no readable date, description or amount."""
    c = coerce(require_columns(normalize_column_names(df)), date_formats)
    return c.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(F.col(x).isNull()).alias(f"bad_{x}") for x in REQUIRED_COLUMNS])


def coerce(df: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """C3-C5 on the required columns; other columns pass through unchanged."""
    types = {f.name: f.dataType for f in df.schema.fields}
    desc = F.col("description")
    return df.withColumns({
        "date": parse_timestamp(F.col("date"), date_formats, types.get("date")),
        "description": normalize_text(desc if isinstance(types.get("description"), T.StringType)
                                      else desc.cast("string")),
        "amount": coerce_double(F.col("amount"), types.get("amount")),
    })


def drop_invalid(df: DataFrame) -> DataFrame:
    """C6."""
    return df.dropna(subset=REQUIRED_COLUMNS)


def dedupe(df: DataFrame) -> DataFrame:
    """Full-row duplicates (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def order_by_date(df: DataFrame, key: str | None = "transaction_id") -> DataFrame:
    """Ascending date, ties by key. Use only at the output: a global sort is a range shuffle."""
    cols = ["date"] + ([key] if key and key in df.columns else [])
    return df.orderBy(*cols)


def date_positions(df: DataFrame, key: str = "transaction_id", name: str = "pos") -> DataFrame:
    """Every row with its 1-based position by ascending date (undated rows last), ties by key."""
    return dense_index(df, [F.col("date").asc_nulls_last(), F.col(key).asc_nulls_last()], name)


def clean_transactions(df: DataFrame, date_formats: list[str] | None = None,
                       sort: bool = False) -> DataFrame:
    """C11 = C1 -> C2 -> C3/C4/C5 -> C6 -> C7 [-> C8].

    The reference keeps the text 'nan' for a missing description; here a missing
    description stays null and the row is dropped (SURVEY Q5).
    """
    df = require_columns(normalize_column_names(df))
    df = dedupe(drop_invalid(coerce(df, date_formats)))
    return order_by_date(df) if sort else df


def normalize_upload_types(df: DataFrame) -> DataFrame:
    """Integral columns -> double (nullable ints become floats on upload); strings kept."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if isinstance(f.dataType, integral) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def map_na_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Map the NA token set to null on string columns (pandas read_csv semantics)."""
    toks = F.array(*[F.lit(t) for t in tokens])
    return df.select(*[F.when(F.array_contains(toks, F.col(f"`{f.name}`")), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude=("target", "transaction_id", "year_month", "id")) -> list[str]:
    """Numeric columns (BooleanType is not numeric), minus excluded names."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: column, dtype, non_null, nulls. One scan, one aggregate."""
    fields = df.schema.fields
    aggs = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"nn__{f.name}"), F.count_if(c.isNull()).alias(f"nu__{f.name}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.col(f"`nn__{f.name}`").alias("non_null"),
                              F.col(f"`nu__{f.name}`").alias("nulls"))
                     for f in fields])
    return wide.select(F.inline(rows))


def preview(df: DataFrame, n: int = 5, key: str = "transaction_id") -> DataFrame:
    """C10 head(n) in key order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(key).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """C10 row and column count as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
