"""Display formatting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["display_date", "display_money", "report_number", "report_label"]


def display_date(ts: Column) -> Column:
    """``%Y-%m-%d %H:%M``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def display_money(x: Column) -> Column:
    """``$1,234.50``; negatives as ``$-1,234.50`` (Python ``f"${x:,.2f}"``)."""
    return F.concat(F.lit("$"), F.format_number(x, 2))


def report_number(x: Column) -> Column:
    """``{:,.2f}``."""
    return F.format_number(x, 2)


def report_label(x: Column) -> Column:
    return F.upper(x)
