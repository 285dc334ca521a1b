"""Calendar features (F1-F5, F11) and time arithmetic on timestamp columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["calendar_columns", "day_of_week", "year_month", "epoch_micros", "whole_days_between",
           "MICROS_PER_DAY"]

MICROS_PER_DAY = 86_400_000_000


def day_of_week(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday (F2)."""
    return F.weekday(d)


def year_month(d: Column) -> Column:
    """Month period as ``yyyy-MM``."""
    return F.date_format(d, "yyyy-MM")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch; session time zone is pinned to UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floor of the exact difference (not calendar ``datediff``)."""
    return F.floor((epoch_micros(later) - epoch_micros(earlier)) / F.lit(MICROS_PER_DAY)).cast("long")


def calendar_columns(d: Column, with_name: bool = True) -> dict[str, Column]:
    """Year, month, day, day_of_week, [day_name], week_of_year, quarter, flags."""
    dow = day_of_week(d)
    cols = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": dow,
    }
    if with_name:
        cols["day_name"] = F.date_format(d, "EEEE")
    cols.update({
        "week_of_year": F.weekofyear(d),           # ISO-8601 week
        "quarter": F.quarter(d),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (F.to_date(d) == F.last_day(d)).cast("int"),
    })
    return cols
