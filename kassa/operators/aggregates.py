"""Ledger aggregations (G1-G8, G15, G18, G19, G21-G23).  All are hash aggregates with
map-side partial aggregation, so a hot group is pre-combined before the shuffle."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.functions.amounts import spend
from kassa.functions.calendar import year_month


def monthly_summary(df: DataFrame) -> DataFrame:
    """Month, total_spent = |sum of negatives|, transaction_count = non-null ids."""
    a = F.col("amount")
    return (df.groupBy(year_month(F.col("date")).alias("month"))
            .agg(F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0))).alias("total_spent"),
                 F.count("transaction_id").alias("transaction_count")))


def category_breakdown(df: DataFrame, col: str = "category") -> DataFrame:
    """Expenses only: total, avg_transaction, count by category, total desc."""
    x = F.abs(F.col("amount"))
    return (df.filter(F.col("amount") < 0).groupBy(col)
            .agg(F.sum(x).alias("total"), F.avg(x).alias("avg_transaction"), F.count(x).alias("count"))
            .orderBy(F.desc("total"), col))


def daily_spend(df: DataFrame, series: list[str] | None = None) -> DataFrame:
    """G7 (series=None) / G8 (series=[col]): ds date, y = sum of expense magnitudes.

    Income-only days stay with y = 0.  All series in one aggregate (no per-category loop).
    """
    series = series or []
    d = df.where(F.col("date").isNotNull() & F.col("amount").isNotNull())
    return d.groupBy(*series, F.to_date("date").alias("ds")).agg(F.sum(spend(F.col("amount"))).alias("y"))


def income_expense_totals(df: DataFrame) -> DataFrame:
    """G18."""
    a = F.col("amount")
    return df.agg(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)).alias("total_income"),
                  F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0))).alias("total_expense"))


def dashboard_totals(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """#transactions, #users, sum(amount) in one aggregate over a tagged union (no join)."""
    t = transactions.select(F.lit(True).alias("_is_t"), F.col("amount").cast("double").alias("_a"))
    u = users.select(F.lit(False).alias("_is_t"), F.lit(None).cast("double").alias("_a"))
    return t.unionByName(u).agg(F.count_if(F.col("_is_t")).alias("n_transactions"),
                                F.count_if(~F.col("_is_t")).alias("n_users"),
                                F.sum("_a").alias("total_amount"))


def flag_counts(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Flagged, total, percent."""
    n = F.count(F.lit(1))
    k = F.count_if(F.col(flag))
    return df.agg(k.alias("n_flagged"), n.alias("n_total"), (100.0 * k / n).alias("pct_flagged"))


def monthly_income_expense(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """G3/G4 per (keys, month): income, expense (positive), ratio income / (expense + 1)."""
    a = F.col("amount")
    g = (df.groupBy(*(keys or []), year_month(F.col("date")).alias("year_month"))
         .agg(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)).alias("monthly_income"),
              F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0))).alias("monthly_expense")))
    return g.withColumn("income_expense_ratio", F.col("monthly_income") / (F.col("monthly_expense") + 1))
