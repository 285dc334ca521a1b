"""Shared builders for the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame

from kassa.operators.clean import clean_transactions
from kassa.operators.features import FEATURE_COLUMNS, build_all_features, engineer_features
from kassa.sources.testdata import LEDGER_CATEGORIES, Tables

LEDGER_SPEC = "transaction_id long, user_id long, date timestamp, description string, amount double, category string"
_LONG_FEATURES = {"year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
                  "is_month_start", "is_month_end", "is_income", "is_expense", "description_length",
                  "description_word_count", "cat_count", "transaction_count_7d", "monthly_count"}


def feature_spec(cols=FEATURE_COLUMNS, skip=("amount",)) -> str:
    return ", ".join(f"{c} {'long' if c in _LONG_FEATURES else 'double'}" for c in cols if c not in skip)


E1_SPEC = (LEDGER_SPEC + ", " + feature_spec() + ", day_name string, transaction_size string, year_month string, "
           + ", ".join(f"cat_is_{v} boolean" for v in LEDGER_CATEGORIES))
E2_SPEC = LEDGER_SPEC + ", " + feature_spec()


def clean_ledger(t: Tables) -> DataFrame:
    return clean_transactions(t.ledger())


def e1(t: Tables, **kw) -> DataFrame:
    return build_all_features(clean_ledger(t), **kw)


def e2(t: Tables, **kw) -> DataFrame:
    return engineer_features(clean_ledger(t), **kw)


def categorized_fixed(t: Tables, threshold: float = 0.5) -> DataFrame:
    """Deterministic prediction fixture + M11 review flag (consumers of M9-M12)."""
    from kassa.operators.predictions import review_flag
    return review_flag(t.predictions_fixed(), threshold)


# DuckDB twin of categorized_fixed
CATEGORIZED_SQL = "SELECT *, confidence < 0.5 AS needs_review FROM predictions_fixed"
