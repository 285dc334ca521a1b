"""Projections and filters (P1-P14).  Plain predicates: Catalyst pushes them into the scan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.functions.formatting import display_date, display_money


def expenses(df: DataFrame) -> DataFrame:
    """P1."""
    return df.filter(F.col("amount") < 0)


def in_categories(df: DataFrame, categories: list[str] | None = None, col: str = "predicted_category") -> DataFrame:
    """Membership; None = all."""
    return df if categories is None else df.filter(F.col(col).isin(list(categories)))


def min_confidence(df: DataFrame, c: float) -> DataFrame:
    """P3."""
    return df.filter(F.col("confidence") >= c)


def review_only(df: DataFrame) -> DataFrame:
    """P4."""
    return df.filter(F.col("needs_review"))


def by_user(df: DataFrame, user_id: int | None = None, col: str = "user_id") -> DataFrame:
    """P5: only null means no filter."""
    return df if user_id is None else df.filter(F.col(col) == F.lit(user_id))


def by_id(df: DataFrame, ident, col: str = "transaction_id") -> DataFrame:
    """Zero or one row."""
    return df.filter(F.col(col) == F.lit(ident))


def one_category(df: DataFrame, category: str, col: str = "predicted_category") -> DataFrame:
    """P7 (at scale prefer grouping over a loop of slices)."""
    return df.filter(F.col(col) == F.lit(category))


def anomalous(df: DataFrame, col: str = "is_anomaly") -> DataFrame:
    """P8."""
    return df.filter(F.col(col))


def low_confidence_sample(df: DataFrame, below: float = 0.5, n: int = 10,
                          cols=("description", "predicted_category", "confidence"),
                          key: str = "transaction_id") -> DataFrame:
    """First n low-confidence rows (ordered by confidence, key; a top-k, not a full sort)."""
    return (df.filter(F.col("confidence") < below)
            .orderBy("confidence", key).limit(n).select(key, *cols))


def drop_prefix(df: DataFrame, prefix: str = "prob_") -> DataFrame:
    """P10."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


# The columns a listing shows, where a ledger has them.
DISPLAY_COLUMNS = ["transaction_id", "date", "merchant", "description", "account", "amount", "category",
                   "predicted_category", "confidence", "needs_review"]


def display_projection(df: DataFrame, wanted=DISPLAY_COLUMNS) -> DataFrame:
    """Keep listed columns that exist, newest first (ties by key)."""
    cols = [c for c in wanted if c in df.columns]
    order = [F.col("date").desc()] if "date" in df.columns else []
    if "transaction_id" in df.columns:
        order.append(F.col("transaction_id"))
    return df.select(*cols).orderBy(*order)


def public_users(users: DataFrame) -> DataFrame:
    """Id and email only."""
    return users.select("id", "email")


def display_format(df: DataFrame) -> DataFrame:
    """Date as ``%Y-%m-%d %H:%M``, amount as ``$1,234.50``."""
    return df.withColumns({"date_display": display_date(F.col("date")),
                           "amount_display": display_money(F.col("amount"))})
