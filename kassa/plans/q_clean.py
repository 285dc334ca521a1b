"""Sources, cleaning, profiling, filters and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.functions import (amount_columns, calendar_columns, desc_prefix, is_valid_email, report_label,
                             report_number, safe_key, spend, word_count, year_month)
from kassa.operators import clean as C
from kassa.operators import filters as P
from kassa.operators.features import basic_features
from kassa.plans import sqlfrag as S
from kassa.plans.common import CATEGORIZED_SQL, LEDGER_SPEC, categorized_fixed, clean_ledger
from kassa.plans.registry import register
from kassa.session import scratch_path
from kassa.sources.files import indexed_metrics, load_transactions, read_table
from kassa.sources.sinks import write_table
from kassa.sources.testdata import LEDGER_CATEGORIES, METRIC_FEATURES
from kassa.sources.typed_csv import read_csv

WS = S.WS
DIRTY_SPEC = "transaction_id string, user_id string, date timestamp, description string, amount double, category string"
COERCE_DIRTY_SQL = f"""
SELECT "Transaction_ID" AS transaction_id, "User_Id" AS user_id, coalesce(TRY_CAST(" Date " AS TIMESTAMP), try_strptime(" Date ", '%m/%d/%Y')) AS date,
       lower(regexp_replace("Description", '^{WS}+|{WS}+$', '', 'g')) AS description,
       CASE WHEN regexp_full_match("AMOUNT", '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
            THEN TRY_CAST("AMOUNT" AS DOUBLE) END AS amount,
       "Category" AS category FROM ledger_dirty"""
CLEAN_DIRTY_SQL = f"""
SELECT DISTINCT * FROM ({COERCE_DIRTY_SQL}) d
WHERE date IS NOT NULL AND description IS NOT NULL AND amount IS NOT NULL"""


BASIC_FEATURES_SPEC = LEDGER_SPEC + ", month long, day_of_week long, is_weekend long, amount_abs double, is_income long"
BASIC_FEATURES_SQL = """
SELECT *, month(date) AS month, isodow(date) - 1 AS day_of_week, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       abs(amount) AS amount_abs, CASE WHEN amount > 0 THEN 1 ELSE 0 END AS is_income FROM ledger_intraday"""


@register("C11_clean_transactions", DIRTY_SPEC, CLEAN_DIRTY_SQL)
def q_c11(t):
    return C.clean_transactions(t.ledger_dirty())


@register("C1_C5_normalise_and_coerce", DIRTY_SPEC, COERCE_DIRTY_SQL)
def q_c1_c5(t):
    return C.coerce(C.require_columns(C.normalize_column_names(t.ledger_dirty())))


@register("C2_missing_columns", "column string, fault string, n_values long",
          "SELECT \"column\", fault, CASE WHEN fault IS NULL THEN (SELECT count(description) FROM ledger) ELSE 0 END AS n_values "
          "FROM (VALUES ('date', 'absent'), ('description', NULL), ('amount', 'absent')) v(\"column\", fault)")
def q_c2(t):
    return C.column_report(t.ledger().select("description", F.col("amount").alias("sum")))


@register("C3_dropped_rows", "n_rows long, bad_date long, bad_description long, bad_amount long", f"""
SELECT count(*) AS n_rows, count(*) - count(date) AS bad_date, count(*) - count(description) AS bad_description,
       count(*) - count(amount) AS bad_amount FROM ({COERCE_DIRTY_SQL}) x""")
def q_c3_dropped(t):
    return C.dropped_counts(t.ledger_dirty())


@register("C8_first_1000_by_date", "pos long, transaction_id long",
          "SELECT row_number() OVER (ORDER BY date, transaction_id) AS pos, transaction_id FROM ledger "
          "ORDER BY pos LIMIT 1000")
def q_c8(t):
    # the first page of the ordered ledger
    return C.date_positions(t.ledger().select("date", "transaction_id")).where(F.col("pos") <= 1000).select("pos", "transaction_id")


@register("C8_order_whole_ledger", "pos long, transaction_id long",
          "SELECT row_number() OVER (ORDER BY date, transaction_id) AS pos, transaction_id FROM ledger")
def q_c8_whole(t):
    return C.date_positions(t.ledger().select("date", "transaction_id")).select("pos", "transaction_id")


@register("P12_numeric_columns", "row_id long, amount double, user_id long",
          "SELECT transaction_id AS row_id, amount, user_id FROM ledger")
def q_p12(t):
    led = t.ledger()
    return led.select(F.col("transaction_id").alias("row_id"), *sorted(C.numeric_columns(led)))


@register("S1_csv_scan_round_trip", DIRTY_SPEC, CLEAN_DIRTY_SQL)
def q_s1(t):
    path = scratch_path(t.spark, "s1_ledger_dirty_csv")
    t.ledger_dirty().write.mode("overwrite").option("header", True).csv(path)
    return C.clean_transactions(load_transactions(t.spark, path))


@register("S2_upload_type_normalise", "transaction_id double, user_id double, date timestamp, amount double, category string",
          "SELECT CAST(transaction_id AS DOUBLE) AS transaction_id, CAST(user_id AS DOUBLE) AS user_id, date, amount, category FROM ledger")
def q_s2(t):
    return C.normalize_upload_types(t.ledger().drop("description"))


@register("S4_featured_scan_csv", BASIC_FEATURES_SPEC, BASIC_FEATURES_SQL)
def q_s4_csv(t):
    """Features saved as CSV and read again with the types their values have."""
    path = scratch_path(t.spark, "s4_features_csv")
    write_table(basic_features(t.ledger_intraday()), path, "csv")
    return read_table(t.spark, path, "csv")


@register("S4_csv_column_types", "column string, dtype string, non_null long, nulls long",
          "SELECT * FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM ledger_undated"
              for c, d in (("transaction_id", "bigint"), ("user_id", "bigint"), ("date", "timestamp_ntz"),
                           ("description", "string"), ("amount", "double"), ("category", "string"))) + ") p")
def q_s4_types(t):
    """The types that a CSV ledger's values decide, with the profile of what was read."""
    path = scratch_path(t.spark, "s4_ledger_csv")
    write_table(t.ledger_undated(), path, "csv")
    return C.column_profile(read_csv(t.spark, path))


@register("S4_S6_table_scan_round_trip", LEDGER_SPEC, "SELECT * FROM ledger")
def q_s6(t):
    path = scratch_path(t.spark, "s6_ledger_parquet")
    t.ledger().write.mode("overwrite").parquet(path)
    return read_table(t.spark, path)


METRIC_SPEC = "row_id long, " + ", ".join(f"feature_{i} double" for i in range(METRIC_FEATURES))


@register("S5_indexed_metric_scan", METRIC_SPEC, "SELECT * EXCLUDE (target) FROM metrics")
def q_s5(t):
    return indexed_metrics(t.metrics())


_PROFILE_COLS = [("transaction_id", "string"), ("user_id", "string"), ("date", "timestamp_ntz"),
                 ("description", "string"), ("amount", "double"), ("category", "string")]


@register("C9_column_profile", "column string, dtype string, non_null long, nulls long",
          "SELECT * FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls "
              f"FROM ({COERCE_DIRTY_SQL}) x" for c, d in _PROFILE_COLS) + ") p")
def q_c9(t):
    df = C.coerce(C.normalize_column_names(t.ledger_dirty()))
    return C.column_profile(df.select(*[c for c, _ in _PROFILE_COLS]))


@register("C10_preview_head", LEDGER_SPEC, "SELECT * FROM ledger ORDER BY transaction_id LIMIT 5")
def q_c10(t):
    return C.preview(t.ledger(), 5)


@register("C10_shape", "n_rows long, n_columns long", "SELECT count(*) AS n_rows, 6 AS n_columns FROM ledger")
def q_c10_shape(t):
    return C.shape(t.ledger())


# ---- filters ---------------------------------------------------------------------
PRED_SPEC = (LEDGER_SPEC + ", predicted_category string, confidence double, needs_review boolean, "
             + ", ".join(f"prob_{c} double" for c in LEDGER_CATEGORIES))
PRED_SQL = f"WITH p AS ({CATEGORIZED_SQL})\n"


@register("P1_expense_filter", LEDGER_SPEC, "SELECT * FROM ledger WHERE amount < 0")
def q_p1(t):
    return P.expenses(t.ledger())


@register("P2_category_membership", PRED_SPEC,
          PRED_SQL + "SELECT * FROM p WHERE predicted_category IN ('1-URGENT', '3-MEDIUM')")
def q_p2(t):
    return P.in_categories(categorized_fixed(t), ["1-URGENT", "3-MEDIUM"])


@register("P3_min_confidence", PRED_SPEC, PRED_SQL + "SELECT * FROM p WHERE confidence >= 0.6")
def q_p3(t):
    return P.min_confidence(categorized_fixed(t), 0.6)


@register("P4_review_only", PRED_SPEC, PRED_SQL + "SELECT * FROM p WHERE needs_review")
def q_p4(t):
    return P.review_only(categorized_fixed(t))


@register("P5_filter_by_user", LEDGER_SPEC, "SELECT * FROM ledger WHERE user_id = 370")
def q_p5(t):
    return P.by_user(t.ledger(), 370)


@register("P6_point_lookup", LEDGER_SPEC, "SELECT * FROM ledger WHERE transaction_id = 4242")
def q_p6(t):
    return P.by_id(t.ledger(), 4242)


@register("P7_one_category_slice", PRED_SPEC, PRED_SQL + "SELECT * FROM p WHERE predicted_category = '2-HIGH'")
def q_p7(t):
    return P.one_category(categorized_fixed(t), "2-HIGH")


@register("P9_low_confidence_sample", "transaction_id long, description string, predicted_category string, confidence double",
          PRED_SQL + "SELECT transaction_id, description, predicted_category, confidence FROM p "
                     "WHERE confidence < 0.5 ORDER BY confidence, transaction_id LIMIT 10")
def q_p9(t):
    return P.low_confidence_sample(categorized_fixed(t))


@register("P10_drop_prob_columns", LEDGER_SPEC + ", predicted_category string, confidence double, needs_review boolean",
          PRED_SQL + "SELECT * FROM p")
def q_p10(t):
    df = P.drop_prefix(categorized_fixed(t))
    assert not any(c.startswith("prob_") for c in df.columns)
    return df


@register("P11_display_projection",
          "transaction_id long, date timestamp, description string, amount double, category string, "
          "predicted_category string, confidence double, needs_review boolean",
          PRED_SQL + "SELECT transaction_id, date, description, amount, category, predicted_category, confidence, "
                     "needs_review FROM p")
def q_p11(t):
    return P.display_projection(categorized_fixed(t))


@register("P13_public_users", "id long, email string", "SELECT id, email FROM users")
def q_p13(t):
    return P.public_users(t.users())


@register("P14_display_format", "transaction_id long, date_display string, amount_display string",
          "SELECT transaction_id, strftime(date, '%Y-%m-%d %H:%M') AS date_display, "
          "'$' || format('{:,.2f}', amount) AS amount_display FROM ledger")
def q_p14(t):
    return P.display_format(t.ledger())


# ---- scalar functions --------------------------------------------------------------
ROW_FEATURE_SPEC = ("transaction_id long, year long, month long, day long, day_of_week long, day_name string, "
                    "week_of_year long, quarter long, is_weekend long, is_month_start long, is_month_end long, "
                    "amount_abs double, is_income long, is_expense long, transaction_size string, "
                    "description_length long, description_word_count long, year_month string, desc_prefix string, "
                    "spend double")


@register("F1_F12_row_features_intraday", ROW_FEATURE_SPEC, f"""
SELECT transaction_id, {S.calendar()}, {S.amounts()}, length(description) AS description_length,
       {S.WORDS.format(x='description')} AS description_word_count, strftime(date, '%Y-%m') AS year_month,
       substr(coalesce(description, ''), 1, 10) AS desc_prefix,
       CASE WHEN amount < 0 THEN -amount ELSE 0 END AS spend
FROM ledger_intraday""")
def q_f_rows(t):
    d, a = F.col("date"), F.col("amount")
    cols = {**calendar_columns(d), **amount_columns(a),
            "description_length": F.length("description"), "description_word_count": word_count(F.col("description")),
            "year_month": year_month(d), "desc_prefix": desc_prefix(F.col("description")), "spend": spend(a)}
    return t.ledger_intraday().withColumns(cols)


@register("F9_basic_features", "transaction_id long, month long, day_of_week long, is_weekend long, "
          "amount_abs double, is_income long",
          "SELECT transaction_id, month(date) AS month, isodow(date) - 1 AS day_of_week, "
          "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, abs(amount) AS amount_abs, "
          "CASE WHEN amount > 0 THEN 1 ELSE 0 END AS is_income FROM ledger")
def q_f9(t):
    return basic_features(t.ledger())


@register("F13_safe_series_key", "category string, safe_key string", f"""
SELECT DISTINCT category, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(category, '^{WS}+|{WS}+$', '', 'g'),
       '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'category') AS safe_key
FROM (SELECT category FROM ledger_learnable UNION ALL SELECT category FROM ledger) c""")
def q_f13(t):
    cats = t.ledger_learnable().select("category").unionByName(t.ledger().select("category"))
    return cats.distinct().withColumn("safe_key", safe_key(F.col("category")))


@register("F14_report_formatting", "category string, label string, total string", """
SELECT category, upper(category) AS label, format('{:,.2f}', sum(-amount)) AS total
FROM ledger WHERE amount < 0 GROUP BY category""")
def q_f14(t):
    e = P.expenses(t.ledger()).groupBy("category").agg(F.sum(-F.col("amount")).alias("_t"))
    return e.select("category", report_label(F.col("category")).alias("label"), report_number(F.col("_t")).alias("total"))


@register("F17_email_validity", "id long, email string, valid boolean",
          "SELECT id, email, coalesce(regexp_full_match(email, "
          "'^[A-Za-z0-9._%+#-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}$'), false) AS valid FROM users")
def q_f17(t):
    u = t.users()
    return u.select("id", "email", is_valid_email(F.col("email")).alias("valid"))
