"""Joins (J1-J6).  Equi joins only; no broadcast hints on data-sized sides: the
statistics sides are aggregates whose measured size lets AQE choose a broadcast,
and a hot key on the large side is split by AQE's skew-join handling."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.functions.text import desc_prefix
from kassa.operators.features import prefix_stats
from kassa.session import materialise


def attach_stats(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
    """Left equi join of per-group statistics.

    The statistics are written first, so a small table is broadcast by its true size and the
    large side is not shuffled by a key of few values."""
    return df.join(materialise(stats, "stats"), on=on, how="left")


def attach_prefix_stats(df: DataFrame) -> DataFrame:
    """Stats by 10-char description prefix, missing -> 0."""
    stats = materialise(prefix_stats(df), "prefix_stats")
    return (df.withColumn("_prefix", desc_prefix(F.col("description"))).join(stats, "_prefix", "left")
            .drop("_prefix").fillna(0, subset=["cat_mean", "cat_std", "cat_count"]))


def with_owner(transactions: DataFrame, users: DataFrame, how: str = "inner") -> DataFrame:
    """Transactions.user_id = users.id."""
    u = users.select(F.col("id").alias("_uid"), "email")
    return transactions.join(u, transactions.user_id == u._uid, how).drop("_uid")


def user_activity(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """J4 other direction: every user with their transaction count and total.

    Transactions are aggregated per user first (map-side combine), so the join sees
    one row per user on both sides and a hot user costs nothing extra."""
    agg = transactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_transactions"),
                                              F.sum("amount").alias("total_amount"))
    return (users.join(agg, users.id == agg.user_id, "left")
            .select("id", "email", F.coalesce("n_transactions", F.lit(0)).alias("n_transactions"), "total_amount"))


def new_emails(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose email is not registered yet."""
    return candidates.join(users.select("email"), "email", "left_anti")


def referential_split(transactions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by existence of the owner."""
    ids = users.select(F.col("id").alias("user_id"))
    return (transactions.join(ids, "user_id", "left_semi"), transactions.join(ids, "user_id", "left_anti"))
