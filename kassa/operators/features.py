"""Feature pipelines: E1 (training variant), E2 (serving variant), F9, X1, X2.

Both variants produce the same 33 numeric model inputs (FEATURE_COLUMNS) with the
reference's two different definitions (SURVEY Q2).  Windows are per ``keys``
(default ``user_id``) ordered by (date, transaction_id); a one-key input gives the
reference's whole-file result.

Plan shape (checked with explain): after cleaning, whole rows are exchanged once, for the join with
their features by row number.  The features come from a narrow frame (keys, time, id, amount): a
range exchange and one on (key, part) that the ordered sequence, the row-count windows and the
monthly statistics share.  Per-category / per-prefix statistics are aggregated first and
joined (AQE turns that join into a broadcast when the measured side is small).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.functions.amounts import amount_columns
from kassa.functions.calendar import calendar_columns, whole_days_between, year_month
from kassa.functions.text import desc_prefix, word_count
from kassa.operators import labels
from kassa.operators import sequence as seq
from kassa.session import materialise

# The 33 numeric model inputs, in model order.
FEATURE_COLUMNS = [
    "amount", "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
    "is_month_start", "is_month_end", "amount_abs", "is_income", "is_expense", "description_length",
    "description_word_count", "cat_mean", "cat_std", "cat_count", "rolling_7d_mean", "rolling_7d_std",
    "rolling_30d_mean", "rolling_30d_std", "days_since_last", "transaction_count_7d", "monthly_total",
    "monthly_mean", "monthly_std", "monthly_count", "monthly_abs_sum", "monthly_abs_mean",
    "monthly_income", "monthly_expense", "income_expense_ratio",
]
LABEL_DERIVED = ["cat_mean", "cat_std", "cat_count"]
# Most labels that become one-hot columns: a schema of more is not a label column's.
MAX_ONE_HOT = 1000


def category_values(df: DataFrame, col: str = "category", limit: int = MAX_ONE_HOT) -> list[str]:
    """Distinct non-null labels for one-hot columns (schema needs them; bounded check)."""
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"more than {limit} distinct values in {col}: not a label column")
    return sorted(vals)


def one_hot(df: DataFrame, values: list[str], col: str = "category", prefix: str = "cat_is_") -> DataFrame:
    """Boolean indicator per value (named cat_is_<v>, SURVEY Q16)."""
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in values})


def basic_features(df: DataFrame) -> DataFrame:
    """month, day_of_week, is_weekend, amount_abs, is_income."""
    d = F.col("date")
    cal = calendar_columns(d, with_name=False)
    amt = amount_columns(F.col("amount"))
    return df.withColumns({"month": cal["month"], "day_of_week": cal["day_of_week"],
                           "is_weekend": cal["is_weekend"], "amount_abs": amt["amount_abs"],
                           "is_income": amt["is_income"]})


def row_features(df: DataFrame, mode: str = "training") -> DataFrame:
    """F1-F8: calendar, amount and description features (no shuffle)."""
    cols = dict(calendar_columns(F.col("date"), with_name=(mode == "training")))
    amt = amount_columns(F.col("amount"))
    if mode != "training":
        amt.pop("transaction_size")
    cols.update(amt)
    if "description" in df.columns:
        desc = F.col("description") if mode == "training" else F.coalesce(F.col("description"), F.lit(""))
        cols["description_length"] = F.length(desc)
        cols["description_word_count"] = word_count(desc)
    cols["year_month"] = year_month(F.col("date"))
    return df.withColumns(cols)


def monthly_aggregates(mode: str = "training") -> dict:
    """Plain aggregates of one month's amounts (in a group or over a window); see ``monthly_derived``."""
    a = F.col("amount")
    return {"monthly_total": F.sum(a), "monthly_mean": F.avg(a), "monthly_std": F.stddev_samp(a),
            "monthly_count": F.count(a), "monthly_abs_sum": F.sum(F.abs(a)), "monthly_abs_mean": F.avg(F.abs(a)),
            "monthly_income": F.sum(F.when(a > 0, a).otherwise(0.0)),
            # positive for training, signed for serving
            "monthly_expense": F.sum(F.when(a < 0, -a if mode == "training" else a).otherwise(0.0))}


def monthly_derived(mode: str = "training") -> dict:
    """What follows from ``monthly_aggregates``: G4, and the serving variant's std of a single row."""
    income, expense = F.col("monthly_income"), F.col("monthly_expense")
    if mode == "training":
        return {"income_expense_ratio": income / (expense + 1)}
    return {"monthly_std": F.coalesce("monthly_std", F.lit(0.0)),
            "income_expense_ratio": F.abs(income) / (F.abs(expense) + 1)}


def monthly_stats(df: DataFrame, keys: list[str], mode: str = "training") -> DataFrame:
    """G2-G4 per (keys, year_month): one aggregate, joined back."""
    g = (df.withColumn("year_month", year_month(F.col("date"))).groupBy(*keys, "year_month")
         .agg(*[e.alias(c) for c, e in monthly_aggregates(mode).items()]))
    return g.withColumns(monthly_derived(mode))


def category_stats(df: DataFrame, col: str = "category") -> DataFrame:
    """G1: mean, sample std, count of amount_abs per category."""
    x = F.abs(F.col("amount"))
    # no null filter here: it would be pushed below a shared dedupe and stop exchange
    # reuse; the null group never matches in the left join anyway
    return (df.groupBy(col)
            .agg(F.avg(x).alias("cat_mean"), F.stddev_samp(x).alias("cat_std"), F.count(x).alias("cat_count")))


def prefix_stats(df: DataFrame) -> DataFrame:
    """J3 input: mean, sample std, count of signed amount per 10-char description prefix."""
    a = F.col("amount")
    return (df.withColumn("_prefix", desc_prefix(F.col("description"))).groupBy("_prefix")
            .agg(F.avg(a).alias("cat_mean"), F.stddev_samp(a).alias("cat_std"), F.count(a).alias("cat_count")))


# Rows that a 30-row frame looks back.
ROLLING_HALO = 29


def rolling_frames(value: str):
    """W1-W4 / W11 as frames of ``sequence``: 7- and 30-row mean and sample std (n=1 -> 0)."""
    v = F.col(value)
    return {
        "rolling_7d_mean": lambda w: F.avg(v).over(w.rowsBetween(-6, 0)),
        "rolling_7d_std": lambda w: F.coalesce(F.stddev_samp(v).over(w.rowsBetween(-6, 0)), F.lit(0.0)),
        "rolling_30d_mean": lambda w: F.avg(v).over(w.rowsBetween(-ROLLING_HALO, 0)),
        "rolling_30d_std": lambda w: F.coalesce(F.stddev_samp(v).over(w.rowsBetween(-ROLLING_HALO, 0)), F.lit(0.0)),
    }


def build_features(df: DataFrame, keys: list[str] | None = None, mode: str = "training",
                   categories: list[str] | None = None, feature_set: str = "full",
                   chunk_rows: int = seq.DEFAULT_CHUNK_ROWS, monthly: bool = True, sparse_labels: bool = False) -> DataFrame:
    """E1 (``mode="training"``) / E2 (``mode="serving"``).

    Input: cleaned ledger with transaction_id, date, description, amount[, category][, keys].
    Output: input columns + features.  ``feature_set="no_label"`` leaves out the
    label-derived cat_* statistics (SURVEY Q3).  ``sparse_labels`` gives the one-hot labels as one sparse
    vector ``label_vector`` over a dictionary table instead of a column each, for any number of labels.
    """
    keys = ["user_id"] if keys is None else list(keys)
    training = mode == "training"
    has_cat = "category" in df.columns
    # The input feeds the ordered sequence, the join below and the per-category statistics.
    # Written once, they share one scan and cleaning shuffle, and a row's number stays the same.
    base = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "features_input")

    # Ordered sequence over keys, time, id and amount only: position, previous timestamp, 7-day
    # count (training) / day rank (serving), rolling and monthly statistics.  The rest of a
    # row waits for one join by its number.
    # (``monthly=False`` leaves the monthly ones out for consumers that do not read them)
    a = F.col("amount")
    narrow = base.select(*dict.fromkeys([*keys, "date", "transaction_id"]), "_row", "amount",
                         (F.abs(a) if training else a).alias("_value"))
    s = seq.sequence(narrow, keys, lookback_days=7 if training else None, count_name="transaction_count_7d",
                     frames=rolling_frames("_value"), halo=ROLLING_HALO,
                     groups=(year_month(F.col("date")), monthly_aggregates(mode)) if monthly else None,
                     chunk_rows=chunk_rows)
    s = s.withColumn("days_since_last",
                     F.coalesce(whole_days_between(F.col("date"), F.col(seq.PREV_TS)), F.lit(0)).cast("double"))
    if not training:
        s = s.withColumn("transaction_count_7d", F.col(seq.DAY_RANK))
    s = s.withColumns(monthly_derived(mode) if monthly else {}).drop(*keys, "date", "transaction_id", "amount", "_value", seq.RANK, seq.DAY_RANK, seq.PREV_TS)
    out = row_features(base.join(s, "_row").drop("_row"), mode)

    if training:
        if has_cat:
            if sparse_labels:
                out = labels.one_hot_vector(out, labels.label_dictionary(base))
            else:
                out = one_hot(out, categories if categories is not None else category_values(base))
            if feature_set == "full":
                # written first: the planner sees the true size of one row per category
                # and leaves the ledger where it is whenever that is small
                out = out.join(materialise(category_stats(base), "category_stats"), on="category", how="left")
    else:
        stats = materialise(prefix_stats(base), "prefix_stats")
        out = (out.withColumn("_prefix", desc_prefix(F.col("description")))
               .join(stats, on="_prefix", how="left").drop("_prefix")
               .fillna(0, subset=LABEL_DERIVED))
        out = out.drop("year_month")
    return out


def build_all_features(df: DataFrame, **kw) -> DataFrame:
    """E1."""
    return build_features(df, mode="training", **kw)


def engineer_features(df: DataFrame, **kw) -> DataFrame:
    """E2."""
    return build_features(df, mode="serving", **kw)


def align_features(df: DataFrame, expected: list[str], defaults: dict | None = None) -> DataFrame:
    """Add missing expected columns (default from ``defaults`` else 0), null -> 0.

    Returns the input columns plus the expected feature columns as doubles.
    """
    defaults = defaults or {}
    present = set(df.columns)
    cols = {c: F.lit(float(defaults.get(c, 0.0))) for c in expected if c not in present}
    out = df.withColumns(cols) if cols else df
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in expected})


def added_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns new after an operator (plan-time, no job)."""
    old = set(before.columns)
    return [c for c in after.columns if c not in old]


def added_profile(before: DataFrame, after: DataFrame) -> DataFrame:
    """X2 as rows: every added column (``name``) and how many values it has (``n_values``); one aggregate."""
    names = added_columns(before, after)
    counts = after.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(names)]
    empty = F.array().cast("array<struct<name:string,n_values:bigint>>")
    return counts.select(F.inline(F.array(*rows) if rows else empty))
