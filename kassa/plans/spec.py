"""Output specs shared by a Spark query and its DuckDB oracle.

A spec is ``"name type, name type, ..."`` with types long, int, double, string,
boolean, date, timestamp.  Dates leave as midnight timestamps (the reference's
``datetime64`` days), so both engines hand over the same value type.  Both sides are projected through the same spec, so column
names, order and types agree, and doubles are rounded to the same number of places.

Why 9: ledger amounts carry 5 decimals, so a mean over n rows is an exact decimal
with up to 9 places when n is 2^a 5^b (n = 16 gives 9).  Rounding to fewer places
can hit an exact tie that the two engines' last bits break differently (8 places
did, on 16-row rolling means); at 9 places those values need no rounding, and the
engines' remaining differences (< 1e-11 measured) stay far below 5e-10.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIGITS = 9

_SPARK = {"long": "bigint", "int": "bigint", "double": "double", "string": "string",
          "boolean": "boolean", "date": "timestamp_ntz", "timestamp": "timestamp_ntz"}
_DUCK = {"long": "BIGINT", "int": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def parse(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        name, typ = part.rsplit(" ", 1)
        out.append((name.strip().strip("`"), typ.strip()))
    return out


def finalize(df: DataFrame, spec: str, digits: int = DEFAULT_DIGITS) -> DataFrame:
    cols = []
    for name, typ in parse(spec):
        c = F.col(f"`{name}`")
        if typ == "double":
            c = F.round(c.cast("double"), digits)
        cols.append(c.cast(_SPARK[typ]).alias(name))
    return df.select(*cols)


def finalize_sql(sql: str, spec: str, digits: int = DEFAULT_DIGITS) -> str:
    cols = []
    for name, typ in parse(spec):
        q = '"' + name.replace('"', '""') + '"'
        expr = f"round(CAST({q} AS DOUBLE), {digits})" if typ == "double" else q
        cols.append(f"CAST({expr} AS {_DUCK[typ]}) AS {q}")
    return "SELECT " + ", ".join(cols) + " FROM (\n" + sql + "\n) AS q"
