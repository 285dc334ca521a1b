"""Feature pipelines and windows: E1, E2, W1-W8, W11, flagship."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.plans import sqlfrag as S
from kassa.plans.common import E1_SPEC, E2_SPEC, e1, e2
from kassa.plans.registry import register

B = f"WITH b AS ({S.CLEAN_LEDGER})\n"


@register("E1_build_all_features", E1_SPEC, B + S.features_training())
def q_e1(t):
    return e1(t)


@register("E2_engineer_features", E2_SPEC, B + S.features_serving())
def q_e2(t):
    return e2(t)


FLAGSHIP_SPEC = ("year_month string, category string, spend double, income double, n_transactions long, "
                 "avg_rolling_7d_mean double, avg_rolling_30d_std double, max_transaction_count_7d long, "
                 "avg_days_since_last double")


def monthly_category_spend(feat):
    """Flagship: monthly spend by category with rolling statistics (G14 over E1)."""
    a = F.col("amount")
    return (feat.groupBy("year_month", "category")
            .agg(F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0))).alias("spend"),
                 F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)).alias("income"),
                 F.count(F.lit(1)).alias("n_transactions"),
                 F.avg("rolling_7d_mean").alias("avg_rolling_7d_mean"),
                 F.avg("rolling_30d_std").alias("avg_rolling_30d_std"),
                 F.max("transaction_count_7d").alias("max_transaction_count_7d"),
                 F.avg("days_since_last").alias("avg_days_since_last")))


@register("flagship_monthly_category_spend", FLAGSHIP_SPEC, B + f"""
SELECT year_month, category, abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS spend,
       coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS income, count(*) AS n_transactions,
       avg(rolling_7d_mean) AS avg_rolling_7d_mean, avg(rolling_30d_std) AS avg_rolling_30d_std,
       max(transaction_count_7d) AS max_transaction_count_7d, avg(days_since_last) AS avg_days_since_last
FROM ({S.features_training(with_cat=False)}) f GROUP BY year_month, category""")
def q_flagship(t):
    from kassa.operators.features import build_all_features
    from kassa.plans.common import clean_ledger
    return monthly_category_spend(build_all_features(clean_ledger(t), categories=[], feature_set="no_label",
                                                     monthly=False))
