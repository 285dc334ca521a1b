"""Consumers of predictions on the deterministic fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.operators import predictions as PR
from kassa.operators import reports as R
from kassa.plans.common import CATEGORIZED_SQL, categorized_fixed
from kassa.plans.registry import register

# Totals over the whole ledger (~1e6) carry ~1e-9 of summation-order noise between
# engines; their exact values have 5 decimals, so 6 places compare them exactly.
WHOLE_TABLE_DIGITS = 6
from kassa.sources.testdata import LEDGER_CATEGORIES

P = f"WITH p AS ({CATEGORIZED_SQL}),\n"
LONG = P + "lp AS (" + " UNION ALL ".join(
    f"SELECT transaction_id, '{c}' AS c, \"prob_{c}\" AS prob FROM p" for c in LEDGER_CATEGORIES) + "),\n" + \
    "rk AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY prob DESC, c) AS r FROM lp)\n"


@register("M10_M11_confidence_and_review", "transaction_id long, confidence double, needs_review boolean",
          "SELECT transaction_id, greatest(" + ", ".join(f'"prob_{c}"' for c in LEDGER_CATEGORIES)
          + ") AS confidence, greatest(" + ", ".join(f'"prob_{c}"' for c in LEDGER_CATEGORIES)
          + ") < 0.7 AS needs_review FROM predictions_fixed")
def q_m10(t):
    df = PR.confidence_from_probs(t.predictions_fixed().drop("confidence"))
    return PR.review_flag(df, 0.7)


@register("M11_threshold_zero", "transaction_id long, needs_review boolean",
          "SELECT transaction_id, false AS needs_review FROM predictions_fixed")
def q_m11(t):
    return PR.review_flag(t.predictions_fixed(), 0.0)


@register("T4_top3_per_row", "transaction_id long, " + ", ".join(
    f"top_{i}_category string, top_{i}_prob double" for i in (1, 2, 3)),
    LONG + "SELECT transaction_id, " + ", ".join(
        f"max(c) FILTER (WHERE r = {i}) AS top_{i}_category, max(prob) FILTER (WHERE r = {i}) AS top_{i}_prob"
        for i in (1, 2, 3)) + " FROM rk GROUP BY transaction_id")
def q_t4(t):
    return PR.top_k(categorized_fixed(t), 3)


@register("T5_ranked_probabilities", "transaction_id long, rank long, category string, probability double",
          LONG + "SELECT transaction_id, r AS rank, c AS category, prob AS probability FROM rk")
def q_t5(t):
    df = PR.ranked_probabilities(categorized_fixed(t))
    return df.select("transaction_id", F.posexplode("ranked_probabilities").alias("pos", "s")) \
        .select("transaction_id", (F.col("pos") + 1).alias("rank"), "s.category", "s.probability")


@register("M5_accuracy", "accuracy double, n long",
          "SELECT avg(CAST(category = predicted_category AS DOUBLE)) AS accuracy, count(*) AS n FROM predictions_fixed")
def q_m5(t):
    return PR.accuracy(t.predictions_fixed())


@register("M6_classification_report", "class string, precision double, recall double, f1 double, support long", """
WITH per AS (
  SELECT cls AS class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support
  FROM (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted
        FROM (SELECT category AS cls, count(*) AS support, count(*) FILTER (WHERE category = predicted_category) AS tp
              FROM predictions_fixed GROUP BY 1) a
        FULL JOIN (SELECT predicted_category AS cls, count(*) AS predicted FROM predictions_fixed GROUP BY 1) b
        ON a.cls = b.cls) x),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)
SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM f""")
def q_m6(t):
    return PR.classification_report(t.predictions_fixed())


@register("M7_confusion_matrix", "actual string, predicted string, n long", """
WITH cls AS (SELECT category AS c FROM predictions_fixed UNION SELECT predicted_category FROM predictions_fixed),
cnt AS (SELECT category AS actual, predicted_category AS predicted, count(*) AS n FROM predictions_fixed GROUP BY 1, 2)
SELECT a.c AS actual, b.c AS predicted, coalesce(n, 0) AS n
FROM cls a JOIN cls b ON true LEFT JOIN cnt ON cnt.actual = a.c AND cnt.predicted = b.c""")
def q_m7(t):
    return PR.confusion_long(t.predictions_fixed())


@register("G9_predicted_category_breakdown",
          "predicted_category string, count long, total_amount double, avg_amount double, avg_confidence double",
          "SELECT predicted_category, count(*) AS count, round(sum(amount), 2) AS total_amount, "
          "round(avg(amount), 2) AS avg_amount, round(avg(confidence), 2) AS avg_confidence "
          "FROM predictions_fixed GROUP BY 1")
def q_g9(t):
    return PR.predicted_breakdown(t.predictions_fixed())


@register("G10_category_distribution", "predicted_category string, count long",
          "SELECT predicted_category, count(*) AS count FROM predictions_fixed GROUP BY 1")
def q_g10(t):
    return PR.distribution(t.predictions_fixed())


@register("G11_confidence_stats", "mean_confidence double, median_confidence double, min_confidence double, "
          "max_confidence double",
          "SELECT avg(confidence) AS mean_confidence, median(confidence) AS median_confidence, "
          "min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM predictions_fixed")
def q_g11(t):
    return PR.confidence_stats(t.predictions_fixed())


@register("G12_review_summary", "total long, needs_review long, review_pct double, avg_confidence double",
          P + "x AS (SELECT 1) SELECT count(*) AS total, count(*) FILTER (WHERE needs_review) AS needs_review, "
          "100.0 * count(*) FILTER (WHERE needs_review) / count(*) AS review_pct, avg(confidence) AS avg_confidence FROM p")
def q_g12(t):
    return PR.review_summary(categorized_fixed(t))


@register("G13_distinct_categories", "n_categories long",
          "SELECT count(DISTINCT predicted_category) AS n_categories FROM predictions_fixed")
def q_g13(t):
    return PR.distinct_categories(t.predictions_fixed())


@register("G13_category_list", "predicted_category string",
          "SELECT DISTINCT predicted_category FROM predictions_fixed WHERE predicted_category IS NOT NULL")
def q_g13b(t):
    return PR.category_list(t.predictions_fixed())


@register("G14_monthly_spend_by_category", "month string, category string, amount double",
          "SELECT strftime(date, '%Y-%m') AS month, predicted_category AS category, sum(amount) AS amount "
          "FROM predictions_fixed GROUP BY 1, 2")
def q_g14(t):
    return PR.monthly_category_totals(t.predictions_fixed())


@register("G20_confidence_histogram", "bin long, count long, bin_start double, bin_end double, has_marker boolean", """
SELECT b AS bin, coalesce(n, 0) AS count, (b - 1) / 30.0 AS bin_start, b / 30.0 AS bin_end, b = 16 AS has_marker
FROM range(1, 31) r(b) LEFT JOIN (SELECT least(CAST(floor(confidence * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n
                                  FROM predictions_fixed WHERE confidence IS NOT NULL GROUP BY 1) h ON h.bin = r.b""")
def q_g20(t):
    return PR.confidence_histogram(t.predictions_fixed())


@register("R5_categorization_overview",
          "total long, needs_review long, review_pct double, mean_confidence double, median_confidence double, "
          "min_confidence double, max_confidence double, n_categories long, total_amount double",
          P + "x AS (SELECT 1) SELECT count(*) AS total, count(*) FILTER (WHERE needs_review) AS needs_review, "
          "100.0 * count(*) FILTER (WHERE needs_review) / count(*) AS review_pct, avg(confidence) AS mean_confidence, "
          "median(confidence) AS median_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, "
          "count(DISTINCT predicted_category) AS n_categories, sum(amount) AS total_amount FROM p", digits=WHOLE_TABLE_DIGITS)
def q_r5(t):
    return R.categorization_overview(categorized_fixed(t))


@register("R5_overview_tables", "section string, key string, subkey string, value double", P + f"""
x AS (SELECT 1)
SELECT 'distribution' AS section, predicted_category AS key, '' AS subkey, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 2
UNION ALL SELECT 'breakdown', predicted_category, 'total_amount', round(sum(amount), 2) FROM p GROUP BY 2
UNION ALL SELECT 'breakdown', predicted_category, 'avg_amount', round(avg(amount), 2) FROM p GROUP BY 2
UNION ALL SELECT 'breakdown', predicted_category, 'avg_confidence', round(avg(confidence), 2) FROM p GROUP BY 2
UNION ALL SELECT 'monthly', strftime(date, '%Y-%m'), predicted_category, sum(amount) FROM p GROUP BY 2, 3
UNION ALL SELECT 'histogram', lpad(CAST(b AS VARCHAR), 2, '0'), '', CAST(coalesce(n, 0) AS DOUBLE)
FROM range(1, 31) r(b) LEFT JOIN (SELECT least(CAST(floor(confidence * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n
                                  FROM p WHERE confidence IS NOT NULL GROUP BY 1) h ON h.bin = r.b""", digits=WHOLE_TABLE_DIGITS)
def q_r5_tables(t):
    return R.overview_tables(categorized_fixed(t))
