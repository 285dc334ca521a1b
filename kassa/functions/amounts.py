"""Amount features."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["amount_columns", "transaction_size", "spend", "anomaly_label", "SIZE_BINS"]

# Right-closed size bins (0,10] (10,50] (50,100] (100,500] (500,inf)
# with labels tiny, small, medium, large, huge.  Zero falls outside every bin.
SIZE_BINS = [(10.0, "tiny"), (50.0, "small"), (100.0, "medium"), (500.0, "large")]


def transaction_size(amount_abs: Column) -> Column:
    out = F.when(amount_abs <= 0, F.lit(None).cast("string"))
    for upper, label in SIZE_BINS:
        out = out.when(amount_abs <= upper, label)
    return out.when(amount_abs.isNotNull(), "huge")


def amount_columns(amount: Column) -> dict[str, Column]:
    """amount_abs, is_income, is_expense (0 is neither), transaction_size."""
    a = F.abs(amount)
    return {
        "amount_abs": a,
        "is_income": (amount > 0).cast("int"),
        "is_expense": (amount < 0).cast("int"),
        "transaction_size": transaction_size(a),
    }


def spend(amount: Column) -> Column:
    """expense as a positive number, 0 for income and zero rows."""
    return F.when(amount < 0, -amount).otherwise(F.lit(0.0))


def anomaly_label(flag: Column) -> Column:
    """F16."""
    return F.when(flag, "anomaly").otherwise("normal")
