"""Spending forecasts.

The reference fits one model per category in a Python loop and pickles each.  Here
every series is fitted in one grouped job and the models are **a table**
(``forecast_models``: one row per series), so projection, matching and reporting
are joins and aggregates over that table.

Daily series have one row per (series, day): their windows are bounded by the
calendar span, whatever the number of transactions behind them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kassa.functions.text import safe_key
from kassa.operators.aggregates import daily_spend

MODEL_TYPE = "moving_average_v1"
# Moving-average window 7, minimum history 30 daily points, interval z 1.96.
WINDOW = 7
MIN_POINTS = 30
Z = 1.96


def series_frame(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """G8 input: rows tagged with ``series_key`` (missing column -> 'all')."""
    key = F.col(col).cast("string") if col in df.columns else F.lit("all")
    return df.withColumn("series_key", key).where(F.col("series_key").isNotNull())


def daily_series(df: DataFrame, col: str | None = "predicted_category") -> DataFrame:
    """G7 (col=None: one 'total' series) / G8 (per value of col): series_key, ds, y."""
    if col is None:
        return daily_spend(df).withColumn("series_key", F.lit("total")).select("series_key", "ds", "y")
    return daily_spend(series_frame(df, col), ["series_key"])


def fit_total(daily: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """The model of the one total series; too short a history is an error, not an empty table."""
    n = daily.count()
    if n < min_points:
        raise ValueError(f"the total series has {n} days, {min_points} are needed")
    return fit_moving_average(daily, min_points=min_points)


def fit_moving_average(daily: DataFrame, window: int = WINDOW, min_points: int = MIN_POINTS,
                       keys: list[str] | None = None) -> DataFrame:
    """Per series, mean and population std of the last ``window`` daily
    values (fewer if the series is shorter), last date; only series with at least
    ``min_points`` daily rows get a model.  One window + one aggregate for all series."""
    keys = keys or ["series_key"]
    w_desc = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    ranked = daily.withColumn("_rn", F.row_number().over(w_desc))
    recent = F.col("_rn") <= window
    fit = (ranked.groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n_days"), F.max("ds").alias("train_ds_max"),
                F.avg(F.when(recent, F.col("y"))).alias("yhat"),
                F.stddev_pop(F.when(recent, F.col("y"))).alias("sigma"),
                F.count_if(recent).alias("window")))
    extra = [safe_key(F.col("series_key")).alias("safe_key")] if "series_key" in keys else []
    return (fit.where(F.col("n_days") >= min_points)
            .select(*keys, *extra, F.lit(MODEL_TYPE).alias("model_type"), "train_ds_max",
                    F.col("window").cast("int"), "yhat", "sigma", "n_days"))


def skipped_series(daily: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Series without enough history, with their point count."""
    return (daily.groupBy("series_key").agg(F.count(F.lit(1)).alias("n_days"))
            .where(F.col("n_days") < min_points))


def project(models: DataFrame, days: int = 30, z: float = Z, key: str = "series_key",
            keep: list[str] | None = None) -> DataFrame:
    """Days + 1 dates starting at train_ds_max, constant yhat, +- z sigma."""
    ds = F.explode(F.sequence(F.col("train_ds_max"), F.date_add(F.col("train_ds_max"), days)))
    return models.select(*(keep or []), F.col(key).alias("category"), ds.alias("ds"), "yhat",
                         (F.col("yhat") - z * F.col("sigma")).alias("yhat_lower"),
                         (F.col("yhat") + z * F.col("sigma")).alias("yhat_upper"),
                         "train_ds_max")


def summary(forecast: DataFrame) -> DataFrame:
    """M24."""
    cols = ["ds", "yhat", "yhat_lower", "yhat_upper"]
    return forecast.select(*(["category"] if "category" in forecast.columns else []), *cols)


def available_series(models: DataFrame) -> DataFrame:
    """Sorted distinct series having a model."""
    return models.select("series_key").distinct().orderBy("series_key")


def history_and_future_dates(daily: DataFrame, days: int = 30) -> DataFrame:
    """Every history date of each series plus the next ``days`` dates."""
    hist = daily.select("series_key", "ds")
    last = daily.groupBy("series_key").agg(F.max("ds").alias("_m"))
    fut = last.select("series_key", F.explode(F.sequence(F.date_add("_m", 1), F.date_add("_m", days))).alias("ds"))
    return hist.unionByName(fut)


def match_models(requested: DataFrame, models: DataFrame, col: str = "category") -> tuple[DataFrame, DataFrame]:
    """Exact series_key match first, then safe-key match; returns (matched, unmatched).

    matched: requested name, series_key, match ('exact' | 'safe').  Both joins are
    equi-joins against the model table (one row per series).
    """
    req = requested.select(F.col(col).alias("requested")).distinct()
    m = models.select("series_key", "safe_key")
    exact = req.join(m, req.requested == m.series_key, "inner").select("requested", "series_key",
                                                                         F.lit("exact").alias("match"))
    rest = req.join(exact.select("requested"), "requested", "left_anti")
    by_safe = (rest.withColumn("_sk", safe_key(F.col("requested")))
               .join(m, F.col("_sk") == m.safe_key, "inner")
               .groupBy("requested").agg(F.min("series_key").alias("series_key"))
               .withColumn("match", F.lit("safe")))
    matched = exact.unionByName(by_safe)
    unmatched = req.join(matched.select("requested"), "requested", "left_anti")
    return matched, unmatched


def horizon_rows(forecast: DataFrame) -> DataFrame:
    """W10/G16 input: the last ``days`` rows of each series = dates after train_ds_max."""
    return forecast.where(F.col("ds") > F.col("train_ds_max"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Sums of yhat / lower / upper over the horizon rows."""
    h = horizon_rows(forecast)
    return h.agg(F.sum("yhat").alias("total_predicted"), F.sum("yhat_lower").alias("total_lower"),
                 F.sum("yhat_upper").alias("total_upper"))


def predicted_by_category(forecast: DataFrame) -> DataFrame:
    """Predicted spend per category over the horizon rows."""
    return horizon_rows(forecast).groupBy("category").agg(F.sum("yhat").alias("predicted_spend"))


def top_categories(per_category: DataFrame, n: int = 10) -> DataFrame:
    """Largest predicted spend first (ties by name)."""
    return per_category.orderBy(F.desc("predicted_spend"), "category").limit(n)


def risk_category(per_category: DataFrame) -> DataFrame:
    """Category with the largest predicted spend, upper-cased; 'N/A', 0 when empty."""
    # largest spend, ties to the smaller name (same order as top_categories)
    best = per_category.agg(
        F.min_by(F.struct("predicted_spend", "category"), F.struct(-F.col("predicted_spend"), F.col("category")))
        .alias("_b"))
    return best.select(F.coalesce(F.upper(F.col("_b.category")), F.lit("N/A")).alias("risk_category"),
                       F.coalesce(F.col("_b.predicted_spend"), F.lit(0.0)).alias("risk_amount"))


def forecast_tail(forecast: DataFrame, n: int = 20) -> DataFrame:
    """Last n rows of each series."""
    w = Window.partitionBy("category").orderBy(F.col("ds").desc())
    return forecast.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def training_horizon_end(daily: DataFrame) -> DataFrame:
    """max(ds) per series."""
    return daily.groupBy("series_key").agg(F.max("ds").alias("train_ds_max"))
