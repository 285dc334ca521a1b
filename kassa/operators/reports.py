"""Report datasets (R1-R5): the tables behind the reference's pages and PDFs.

Each report is one aggregate over a tagged union of its inputs (no joins of one-row
frames); lists that a report shows (top categories) are label sets, bounded by the
number of categories.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.operators.anomaly import exact_quantile
from kassa.operators.forecast import horizon_rows, predicted_by_category
from kassa.operators.predictions import (confidence_histogram, distribution, monthly_category_totals,
                                         predicted_breakdown)
from kassa.operators.sequence import dense_index
from kassa.session import materialise


def _top_columns(arr, n: int) -> dict:
    cols = {}
    for i in range(1, n + 1):
        cols[f"top_{i}_category"] = F.try_element_at(arr, F.lit(i)).getField("category")
        cols[f"top_{i}_spend"] = F.try_element_at(arr, F.lit(i)).getField("spend")
    return cols


def forecast_report(total_fc: DataFrame, category_fc: DataFrame, days: int, top_n: int = 10) -> DataFrame:
    """Horizon, G16 totals of the total series, T3 risk, T2 top ``top_n`` categories."""
    per = predicted_by_category(category_fc).select("category", F.col("predicted_spend").alias("spend"))
    # top_n rows
    best = per.orderBy(F.desc("spend"), "category").limit(top_n).collect()
    top = F.array(*[F.struct(F.lit(r["category"]).alias("category"), F.lit(r["spend"]).alias("spend")) for r in best]) \
        if best else F.lit(None).cast("array<struct<category:string,spend:double>>")
    totals = horizon_rows(total_fc).agg(F.sum("yhat").alias("total_predicted"), F.sum("yhat_lower").alias("total_lower"),
                                        F.sum("yhat_upper").alias("total_upper")).withColumn("_top", top)
    first = F.try_element_at(F.col("_top"), F.lit(1))
    return totals.select(F.lit(days).alias("horizon_days"), "total_predicted", "total_lower", "total_upper",
                         F.coalesce(F.upper(first["category"]), F.lit("N/A")).alias("risk_category"),
                         F.coalesce(first["spend"], F.lit(0.0)).alias("risk_amount"),
                         *[c.alias(k) for k, c in _top_columns(F.col("_top"), top_n).items()])


def dashboard_rows(category_fc: DataFrame, total_fc: DataFrame) -> DataFrame:
    """Every category by predicted spend: rank, share of all categories' spend, risk flag,
    and the total model's own prediction with its bounds beside each."""
    per = materialise(predicted_by_category(category_fc), "predicted_spend")
    spend = per.agg(F.sum("predicted_spend").alias("s")).first()["s"]
    total = horizon_rows(total_fc).agg(F.sum("yhat").alias("y"), F.sum("yhat_lower").alias("lo"),
                                       F.sum("yhat_upper").alias("up")).first()
    ranked = dense_index(per, [F.desc("predicted_spend"), "category"], "rank")
    return ranked.select("category", "predicted_spend", F.col("rank").cast("int").alias("rank"),
                        (100.0 * F.col("predicted_spend") / F.lit(spend).cast("double")).alias("share_pct"),
                        F.lit(total["y"]).cast("double").alias("total_predicted"),
                        F.lit(total["lo"]).cast("double").alias("total_lower"),
                        F.lit(total["up"]).cast("double").alias("total_upper")) \
        .withColumn("is_risk", F.col("rank") == 1)


def user_forecast_response(user_category_fc: DataFrame, days: int) -> DataFrame:
    """Per user: days, predicted total, category -> spend map, daily average, top category."""
    per = (horizon_rows(user_category_fc).groupBy("user_id", "category")
           .agg(F.sum("yhat").alias("spend")))
    return (per.groupBy("user_id")
            .agg(F.sum("spend").alias("predicted_total"),
                 F.map_from_entries(F.collect_list(F.struct("category", "spend"))).alias("categories"),
                 F.min_by(F.struct("category", "spend"), F.struct(-F.col("spend"), F.col("category"))).alias("_top"),
                 F.count(F.lit(1)).alias("n_categories"))
            .select("user_id", F.lit(days).alias("days"), "predicted_total", "categories",
                    (F.col("predicted_total") / days).alias("daily_average"),
                    F.col("_top.category").alias("top_category"), F.col("_top.spend").alias("top_category_spend"),
                    "n_categories"))


def categorization_overview(pred: DataFrame) -> DataFrame:
    """One-row bundle of G10-G13 statistics over categorized rows."""
    c = F.col("confidence")
    n = F.count(F.lit(1))
    return pred.agg(n.alias("total"), F.count_if(F.col("needs_review")).alias("needs_review"),
                    (100.0 * F.count_if(F.col("needs_review")) / n).alias("review_pct"),
                    F.avg(c).alias("mean_confidence"),
                    F.lit(exact_quantile(pred, "confidence", 0.5)).cast("double").alias("median_confidence"),
                    F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
                    F.count_distinct("predicted_category").alias("n_categories"),
                    F.sum("amount").alias("total_amount"))


def overview_tables(pred: DataFrame) -> DataFrame:
    """The overview's tables in one long frame (section, key, subkey, value): distribution (G10),
    breakdown (G9), monthly trend (G14), confidence histogram (G20)."""
    none, text = F.lit(""), "string"
    breakdown = predicted_breakdown(pred)
    parts = [distribution(pred).select(F.lit("distribution").alias("section"), F.col("predicted_category").alias("key"),
                                       none.alias("subkey"), F.col("count").cast("double").alias("value"))]
    parts += [breakdown.select(F.lit("breakdown").alias("section"), F.col("predicted_category").alias("key"),
                               F.lit(c).alias("subkey"), F.col(c).cast("double").alias("value"))
              for c in ("total_amount", "avg_amount", "avg_confidence")]
    parts.append(monthly_category_totals(pred).select(F.lit("monthly").alias("section"), F.col("month").alias("key"),
                                                      F.col("category").alias("subkey"), F.col("amount").alias("value")))
    parts.append(confidence_histogram(pred).select(F.lit("histogram").alias("section"),
                                                   F.lpad(F.col("bin").cast(text), 2, "0").alias("key"),
                                                   none.alias("subkey"), F.col("count").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def executive_series(category_fc: DataFrame) -> DataFrame:
    """R2: every category's predicted series over the horizon, with its share of each day."""
    rows = horizon_rows(category_fc)
    days = rows.groupBy(F.col("ds").alias("day")).agg(F.sum("yhat").alias("s"))   # one row per day
    return rows.join(days, F.col("ds") == F.col("day")).select(
        "category", "ds", "yhat", "yhat_lower", "yhat_upper", (100.0 * F.col("yhat") / F.col("s")).alias("share_pct"))


def executive_report(total_fc: DataFrame, category_fc: DataFrame, scored: DataFrame, days: int) -> DataFrame:
    """R2: total, risk, number of category series and anomaly count (the reference
    passes no anomalies; here they come from the scorer, SURVEY Q17)."""
    tot = horizon_rows(total_fc).select(F.lit(0).alias("_s"), F.col("yhat").alias("v"),
                                        F.lit(None).cast("string").alias("category"))
    per = predicted_by_category(category_fc).select(F.lit(1).alias("_s"), F.col("predicted_spend").alias("v"), "category")
    an = scored.select(F.lit(2).alias("_s"), F.col("is_anomaly").cast("double").alias("v"),
                       F.lit(None).cast("string").alias("category"))
    s = F.col("_s")
    agg = tot.unionByName(per).unionByName(an).agg(
        F.sum(F.when(s == 0, F.col("v"))).alias("total_predicted"),
        F.min_by(F.struct("category", "v"), F.when(s == 1, F.struct(-F.col("v"), F.col("category")))).alias("_risk"),
        F.count_if(s == 1).alias("n_category_series"),
        F.coalesce(F.sum(F.when(s == 2, F.col("v"))), F.lit(0.0)).cast("long").alias("n_anomalies"),
        F.count_if(s == 2).alias("n_scored"))
    return agg.select(F.lit(days).alias("horizon_days"), "total_predicted",
                      F.coalesce(F.upper("_risk.category"), F.lit("N/A")).alias("risk_category"),
                      F.coalesce(F.col("_risk.v"), F.lit(0.0)).alias("risk_amount"),
                      "n_category_series", "n_anomalies", "n_scored")
