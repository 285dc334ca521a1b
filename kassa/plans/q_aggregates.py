"""Aggregates, windows and joins over the ledger."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.operators import aggregates as G
from kassa.operators import features as FE
from kassa.operators import joins as J
from kassa.operators import windows as W
from kassa.plans import sqlfrag as S
from kassa.plans.common import LEDGER_SPEC, clean_ledger
from kassa.plans.registry import register
from kassa.session import scratch_path
from kassa.sources.bucketed import new_name, save_bucketed

# Totals over the whole ledger (~1e6) carry ~1e-9 of summation-order noise between
# engines; their exact values have 5 decimals, so 6 places compare them exactly.
WHOLE_TABLE_DIGITS = 6
from kassa.sources.testdata import LEDGER_CATEGORIES

B = f"WITH b AS ({S.CLEAN_LEDGER})\n"


@register("G1_category_stats", "category string, cat_mean double, cat_std double, cat_count long",
          "SELECT category, avg(abs(amount)) AS cat_mean, stddev_samp(abs(amount)) AS cat_std, "
          "count(amount) AS cat_count FROM ledger WHERE category IS NOT NULL GROUP BY category")
def q_g1(t):
    return FE.category_stats(t.ledger()).where(F.col("category").isNotNull())


MONTHLY_SPEC = ("user_id long, year_month string, monthly_total double, monthly_mean double, monthly_std double, "
                "monthly_count long, monthly_abs_sum double, monthly_abs_mean double, monthly_income double, "
                "monthly_expense double, income_expense_ratio double")


@register("G2_G4_monthly_stats", MONTHLY_SPEC, """
SELECT *, monthly_income / (monthly_expense + 1) AS income_expense_ratio FROM (
SELECT user_id, strftime(date, '%Y-%m') AS year_month, sum(amount) AS monthly_total, avg(amount) AS monthly_mean,
       stddev_samp(amount) AS monthly_std, count(amount) AS monthly_count, sum(abs(amount)) AS monthly_abs_sum,
       avg(abs(amount)) AS monthly_abs_mean, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS monthly_income,
       abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS monthly_expense
FROM ledger GROUP BY ALL) m""")
def q_g2(t):
    return FE.monthly_stats(t.ledger(), ["user_id"])


@register("G3_G4_ledger_monthly_income_expense",
          "year_month string, monthly_income double, monthly_expense double, income_expense_ratio double", """
SELECT *, monthly_income / (monthly_expense + 1) AS income_expense_ratio FROM (
SELECT strftime(date, '%Y-%m') AS year_month, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS monthly_income,
       abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS monthly_expense FROM ledger GROUP BY 1) m""")
def q_g3(t):
    return G.monthly_income_expense(t.ledger())


@register("G5_monthly_summary", "month string, total_spent double, transaction_count long", """
SELECT strftime(date, '%Y-%m') AS month, abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS total_spent,
       count(transaction_id) AS transaction_count FROM ledger GROUP BY 1""")
def q_g5(t):
    return G.monthly_summary(t.ledger())


@register("G6_category_breakdown", "category string, total double, avg_transaction double, count long", """
SELECT category, sum(abs(amount)) AS total, avg(abs(amount)) AS avg_transaction, count(amount) AS count
FROM ledger WHERE amount < 0 GROUP BY category""")
def q_g6(t):
    return G.category_breakdown(t.ledger())


@register("G7_daily_spend", "ds date, y double", """
SELECT CAST(date AS DATE) AS ds, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS y
FROM ledger WHERE date IS NOT NULL AND amount IS NOT NULL GROUP BY 1""")
def q_g7(t):
    return G.daily_spend(t.ledger())


@register("G8_daily_spend_per_category", "category string, ds date, y double", """
SELECT category, CAST(date AS DATE) AS ds, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS y
FROM ledger WHERE date IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2""")
def q_g8(t):
    return G.daily_spend(t.ledger(), ["category"])


@register("G15_dashboard_totals", "n_transactions long, n_users long, total_amount double",
          "SELECT (SELECT count(*) FROM ledger) AS n_transactions, (SELECT count(*) FROM users) AS n_users, "
          "(SELECT sum(amount) FROM ledger) AS total_amount", digits=WHOLE_TABLE_DIGITS)
def q_g15(t):
    return G.dashboard_totals(t.ledger(), t.users())


@register("G18_income_expense_totals", "total_income double, total_expense double",
          "SELECT coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS total_income, "
          "abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS total_expense FROM ledger", digits=WHOLE_TABLE_DIGITS)
def q_g18(t):
    return G.income_expense_totals(t.ledger())


@register("G21_one_hot_category", "transaction_id long, " + ", ".join(f"cat_is_{v} boolean" for v in LEDGER_CATEGORIES),
          f"SELECT transaction_id, {S.one_hot()} FROM ledger")
def q_g21(t):
    led = t.ledger()
    return FE.one_hot(led, FE.category_values(led))


# ---- windows -----------------------------------------------------------------------
ROLL_SPEC = "transaction_id long, rolling_7d_mean double, rolling_7d_std double, rolling_30d_mean double, rolling_30d_std double"


@register("W1_W4_rolling_amount_abs", ROLL_SPEC, B + f"SELECT transaction_id, {S.rolling('abs(amount)')} FROM b")
def q_w1(t):
    return W.rolling_stats(clean_ledger(t).withColumn("amount_abs", F.abs("amount")), ["user_id"], "amount_abs")


@register("W1_W4_rolling_small_chunks", ROLL_SPEC,
          f"SELECT transaction_id, {S.rolling('abs(amount)', '1')} FROM ledger_intraday")
def q_w1_chunks(t):
    """One sequence over the whole table in chunks of 64 rows: every chunk but the first has a halo."""
    return W.rolling_stats(t.ledger_intraday().withColumn("amount_abs", F.abs("amount")), [], "amount_abs", chunk_rows=64)


@register("W11_rolling_signed_amount", ROLL_SPEC, B + f"SELECT transaction_id, {S.rolling('amount')} FROM b")
def q_w11(t):
    return W.rolling_stats(clean_ledger(t), ["user_id"], "amount")


@register("W5_days_since_last_intraday", "transaction_id long, days_since_last long",
          f"SELECT transaction_id, {S.days_since_last()} FROM ledger_intraday")
def q_w5(t):
    return W.days_since_last(t.ledger_intraday(), ["user_id"])


@register("W5_days_since_last_undated", "transaction_id long, days_since_last long", """
SELECT transaction_id, CASE WHEN date IS NULL THEN 0 ELSE coalesce(floor((epoch_us(date) - epoch_us(last_value(date IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY date NULLS FIRST, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
       / 86400000000), 0) END AS days_since_last FROM ledger_undated""")
def q_w5_undated(t):
    """Rows without a date stay."""
    return W.days_since_last(t.ledger_undated(), ["user_id"])


@register("W6_count_7d_undated", "transaction_id long, transaction_count_7d double", f"""
SELECT transaction_id, {S.count_7d()} FROM ledger_undated WHERE date IS NOT NULL
UNION ALL SELECT transaction_id, NULL FROM ledger_undated WHERE date IS NULL""")
def q_w6_undated(t):
    """Rows without a date stay, have no count and count in nobody's."""
    return W.count_in_last_days(t.ledger_undated(), ["user_id"], 7)


@register("W6_count_7d_intraday", "transaction_id long, transaction_count_7d long",
          f"SELECT transaction_id, {S.count_7d()} FROM ledger_intraday")
def q_w6(t):
    return W.count_in_last_days(t.ledger_intraday(), ["user_id"], 7)


@register("W6_count_7d_whole_file", "transaction_id long, transaction_count_7d long",
          f"SELECT transaction_id, {S.count_7d('1')} FROM ledger_intraday")
def q_w6_global(t):
    """Reference semantics: one sequence over the whole file (no key)."""
    return W.count_in_last_days(t.ledger_intraday(), [], 7)


@register("W6_count_7d_ledger", "transaction_id long, transaction_count_7d long",
          f"SELECT transaction_id, {S.count_7d()} FROM ledger")
def q_w6_ledger(t):
    return W.count_in_last_days(t.ledger(), ["user_id"], 7)


@register("W7_same_day_rank_intraday", "transaction_id long, transaction_count_7d long",
          "SELECT transaction_id, row_number() OVER (PARTITION BY user_id, CAST(date AS DATE) "
          "ORDER BY date, transaction_id) AS transaction_count_7d FROM ledger_intraday")
def q_w7(t):
    return W.same_day_rank(t.ledger_intraday(), ["user_id"])


@register("W8_monthly_transform", "transaction_id long, " + MONTHLY_SPEC.split(", ", 2)[2], f"""
SELECT l.transaction_id, m.* EXCLUDE (user_id, year_month), m.monthly_income / (m.monthly_expense + 1) AS income_expense_ratio
FROM (SELECT *, strftime(date, '%Y-%m') AS year_month FROM ledger) l LEFT JOIN (
SELECT user_id, strftime(date, '%Y-%m') AS year_month, sum(amount) AS monthly_total, avg(amount) AS monthly_mean,
       stddev_samp(amount) AS monthly_std, count(amount) AS monthly_count, sum(abs(amount)) AS monthly_abs_sum,
       avg(abs(amount)) AS monthly_abs_mean, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS monthly_income,
       abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS monthly_expense
FROM ledger GROUP BY ALL) m USING (user_id, year_month)""")
def q_w8(t):
    return W.monthly_transform(t.ledger(), ["user_id"])


# ---- joins -------------------------------------------------------------------------
@register("J1_attach_category_stats", "transaction_id long, cat_mean double, cat_std double, cat_count long", """
SELECT transaction_id, cat_mean, cat_std, cat_count FROM ledger LEFT JOIN (
  SELECT category, avg(abs(amount)) AS cat_mean, stddev_samp(abs(amount)) AS cat_std, count(amount) AS cat_count
  FROM ledger WHERE category IS NOT NULL GROUP BY category) c USING (category)""")
def q_j1(t):
    led = t.ledger()
    return J.attach_stats(led, FE.category_stats(led), ["category"])


@register("J3_attach_prefix_stats", "transaction_id long, cat_mean double, cat_std double, cat_count long", B + """
SELECT transaction_id, coalesce(cat_mean, 0) AS cat_mean, coalesce(cat_std, 0) AS cat_std, coalesce(cat_count, 0) AS cat_count
FROM (SELECT *, substr(coalesce(description, ''), 1, 10) AS _prefix FROM b) l LEFT JOIN (
  SELECT substr(coalesce(description, ''), 1, 10) AS _prefix, avg(amount) AS cat_mean, stddev_samp(amount) AS cat_std,
         count(amount) AS cat_count FROM b GROUP BY 1) p USING (_prefix)""")
def q_j3(t):
    return J.attach_prefix_stats(clean_ledger(t))


OWNER_SPEC = "transaction_id long, user_id long, amount double, email string"


@register("J4_owner_join_inner", OWNER_SPEC,
          "SELECT transaction_id, user_id, amount, email FROM ledger JOIN users ON ledger.user_id = users.id")
def q_j4(t):
    return J.with_owner(t.ledger(), t.users(), "inner").select("transaction_id", "user_id", "amount", "email")


@register("J4_users_left_transactions", "id long, email string, n_transactions long, total_amount double", """
SELECT id, email, count(transaction_id) AS n_transactions, sum(amount) AS total_amount
FROM users LEFT JOIN ledger ON ledger.user_id = users.id GROUP BY id, email""")
def q_j4b(t):
    return J.user_activity(t.users(), t.ledger())


@register("J5_J6_referential_check", "transaction_id long, user_id long, accepted boolean", """
SELECT transaction_id, user_id, user_id IN (SELECT id FROM users WHERE id % 3 <> 0) AS accepted FROM ledger""")
def q_j6(t):
    users = t.users().where(F.col("id") % 3 != 0)  # a registry missing every third customer
    acc, rej = J.referential_split(t.ledger(), users)
    return (acc.select("transaction_id", "user_id", F.lit(True).alias("accepted"))
            .unionByName(rej.select("transaction_id", "user_id", F.lit(False).alias("accepted"))))


# ---- tables bucketed by user ---------------------------------------------------------
def _bucketed(t, buckets=8):
    rows = save_bucketed(t.ledger(), new_name("ledger"), "user_id", buckets, scratch_path(t.spark, "ledger_by_user"))
    users = save_bucketed(t.users(), new_name("users"), "id", buckets, scratch_path(t.spark, "users_by_id"))
    return rows, users


@register("J4_bucketed_owner_join", LEDGER_SPEC + ", email string",
          "SELECT l.*, email FROM ledger l JOIN users u ON l.user_id = u.id")
def q_j4_bucketed(t):
    """The owner join on tables bucketed by user: no exchange."""
    rows, users = _bucketed(t)
    return J.with_owner(rows, users)


@register("J2_W8_bucketed_monthly", "transaction_id long, monthly_total double, monthly_count long, monthly_income double", """
SELECT transaction_id, sum(amount) OVER w AS monthly_total, count(amount) OVER w AS monthly_count,
       coalesce(sum(amount) FILTER (WHERE amount > 0) OVER w, 0) AS monthly_income
FROM ledger WINDOW w AS (PARTITION BY user_id, strftime(date, '%Y-%m'))""")
def q_j2_bucketed(t):
    """Monthly statistics per user on a bucketed ledger: windows inside the buckets, no exchange."""
    return W.monthly_inside_buckets(_bucketed(t)[0], ["user_id"])
