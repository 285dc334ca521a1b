"""Sinks and snapshot source as write -> read round trips."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kassa.operators import forecast as FC
from kassa.operators import reports as R
from kassa.plans.common import CATEGORIZED_SQL, LEDGER_SPEC, categorized_fixed
from kassa.plans.q_anomaly import SCORED_SQL, SCORED_SPEC, scored
from kassa.plans.q_clean import PRED_SPEC
from kassa.plans.q_forecast import CAT_MODELS, DASHBOARD_SPEC, TOT_MODELS, cat_models, dashboard_sql, tot_models
from kassa.plans import sqlfrag as S
from kassa.plans.registry import register
from kassa.session import scratch_path
from kassa.sources import sinks
from kassa.sources.files import latest_snapshot, read_table
from kassa.sources.testdata import LEDGER_CATEGORIES


def set_times(spark, folder, millis):
    """Gives every file of a folder one modification time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path):
        fs.setTimes(f.getPath(), millis, -1)


@register("S3_latest_snapshot", LEDGER_SPEC, "SELECT * FROM ledger WHERE amount < 0")
def q_s3(t):
    base = scratch_path(t.spark, "s3_snapshots")
    sinks.write_table(t.ledger().repartition(3), f"{base}/categorized_transactions_old", "parquet")
    set_times(t.spark, f"{base}/categorized_transactions_old", 1_000_000_000_000)
    sinks.write_table(t.ledger().where(F.col("amount") < 0).repartition(4), f"{base}/categorized_transactions_new", "parquet")
    return latest_snapshot(t.spark, f"{base}/categorized_transactions_*", fmt="parquet")


@register("S7_featured_sink_round_trip", LEDGER_SPEC, "SELECT * FROM ledger")
def q_s7(t):
    path = scratch_path(t.spark, "s7_ledger_csv")
    sinks.write_table(t.ledger(), path, "csv")
    return read_table(t.spark, path, "csv")


@register("S3_latest_snapshot_csv", LEDGER_SPEC, "SELECT * FROM ledger WHERE amount < 0")
def q_s3_csv(t):
    base = scratch_path(t.spark, "s3_csv_snapshots")
    sinks.write_table(t.ledger().repartition(3), f"{base}/categorized_transactions_old", "csv")
    set_times(t.spark, f"{base}/categorized_transactions_old", 1_000_000_000_000)
    sinks.write_table(t.ledger().where(F.col("amount") < 0).repartition(4), f"{base}/categorized_transactions_new", "csv")
    return latest_snapshot(t.spark, f"{base}/categorized_transactions_*")


@register("S8_review_split_sink", "part string, " + PRED_SPEC,
          f"SELECT 'all' AS part, * FROM ({CATEGORIZED_SQL}) p UNION ALL "
          f"SELECT 'review' AS part, * FROM ({CATEGORIZED_SQL}) p WHERE needs_review")
def q_s8(t):
    base = scratch_path(t.spark, "s8")
    wrote = sinks.write_with_review(categorized_fixed(t), f"{base}/all", f"{base}/review")
    assert wrote
    return (t.spark.read.parquet(f"{base}/all").withColumn("part", F.lit("all"))
            .unionByName(t.spark.read.parquet(f"{base}/review").withColumn("part", F.lit("review"))))


@register("S9_export_review_only", LEDGER_SPEC + ", predicted_category string, confidence double, needs_review boolean",
          f"SELECT * EXCLUDE ({', '.join(chr(34) + 'prob_' + c + chr(34) for c in LEDGER_CATEGORIES)}) "
          f"FROM ({CATEGORIZED_SQL}) p WHERE needs_review")
def q_s9(t):
    prefix = scratch_path(t.spark, "s9/categorized_transactions")
    path = sinks.export(categorized_fixed(t), prefix, review_only=True, fmt="parquet",
                        now=dt.datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("_20240102_030405")
    return t.spark.read.parquet(path)


@register("S9_export_with_probabilities", PRED_SPEC, CATEGORIZED_SQL)
def q_s9_probabilities(t):
    path = sinks.export(categorized_fixed(t), scratch_path(t.spark, "s9/categorized_transactions"),
                        include_probabilities=True, fmt="parquet")
    return t.spark.read.parquet(path)


@register("S10_anomaly_sink", "part string, " + SCORED_SPEC,
          f"SELECT CASE WHEN is_anomaly THEN 'suspicious' ELSE 'normal' END AS part, row_id, reconstruction_error, threshold, "
          f"is_anomaly, anomaly_label FROM ({SCORED_SQL}) s UNION ALL SELECT * FROM (SELECT 'top' AS part, row_id, "
          f"reconstruction_error, threshold, is_anomaly, anomaly_label FROM ({SCORED_SQL}) s2 WHERE is_anomaly "
          f"ORDER BY reconstruction_error DESC, row_id LIMIT 10) p")
def q_s10(t):
    path = scratch_path(t.spark, "s10_anomalies")
    sinks.write_anomalies(scored(t).select("row_id", "reconstruction_error", "threshold", "is_anomaly",
                                           "anomaly_label"), path, f"{path}_top")
    flagged = F.col("is_anomaly").cast("boolean")   # a folder name when read back
    part = F.when(flagged, "suspicious").otherwise("normal")
    return t.spark.read.parquet(path).withColumns({"part": part, "is_anomaly": flagged}).unionByName(
        t.spark.read.parquet(f"{path}_top").withColumn("part", F.lit("top")))


@register("S11_forecast_sinks", "category string, ds date, yhat double, yhat_lower double, yhat_upper double",
          f"SELECT category, ds, yhat, yhat_lower, yhat_upper FROM ({S.project_sql(CAT_MODELS, 30)}) c UNION ALL "
          f"SELECT 'total', ds, yhat, yhat_lower, yhat_upper FROM ({S.project_sql(TOT_MODELS, 30)}) t")
def q_s11(t):
    path = scratch_path(t.spark, "s11_forecasts")
    columns = ["category", "ds", "yhat", "yhat_lower", "yhat_upper"]
    sinks.write_forecasts(FC.project(cat_models(t), 30).select(columns), path, FC.project(tot_models(t), 30).select(columns))
    return (t.spark.read.parquet(f"{path}/categories").select(columns)
            .unionByName(t.spark.read.parquet(f"{path}/total").withColumn("category", F.lit("total"))))


@register("S11_dashboard_sink_per_horizon", "horizon_days long, " + DASHBOARD_SPEC,
          " UNION ALL ".join(f"SELECT {d} AS horizon_days, * FROM ({dashboard_sql(d)}) d{d}" for d in (30, 60, 90)))
def q_s11_dashboard(t):
    path = scratch_path(t.spark, "s11_dashboards")
    rows = None
    for days in (30, 60, 90):
        one = R.dashboard_rows(FC.project(cat_models(t), days), FC.project(tot_models(t), days)).withColumn(
            "horizon_days", F.lit(days))
        rows = one if rows is None else rows.unionByName(one)
    sinks.write_dashboards(rows, path)
    return t.spark.read.parquet(path)
