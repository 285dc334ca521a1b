"""Forecasting and report datasets."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.operators import forecast as FC
from kassa.operators import reports as R
from kassa.operators.aggregates import daily_spend
from kassa.plans import sqlfrag as S
from kassa.plans.common import categorized_fixed
from kassa.plans.registry import register
from kassa.session import materialise

PF = "predictions_fixed"
CAT_DAILY = S.daily_sql(PF, "predicted_category")
TOT_DAILY = S.daily_sql(PF, None)
CAT_MODELS = S.fit_sql(CAT_DAILY)
TOT_MODELS = S.fit_sql(TOT_DAILY)
MODEL_SPEC = ("series_key string, safe_key string, model_type string, train_ds_max date, window long, "
              "yhat double, sigma double, n_days long")
FC_SPEC = "category string, ds date, yhat double, yhat_lower double, yhat_upper double"


def cat_daily(t):
    return FC.daily_series(categorized_fixed(t), "predicted_category")


def tot_daily(t):
    return FC.daily_series(categorized_fixed(t), None)


def cat_models(t):
    return FC.fit_moving_average(cat_daily(t))


def tot_models(t):
    return FC.fit_total(tot_daily(t))


@register("M19_fit_total_moving_average", MODEL_SPEC, TOT_MODELS)
def q_m19(t):
    return tot_models(t)


@register("M20_fit_per_category", MODEL_SPEC, CAT_MODELS)
def q_m20(t):
    return cat_models(t)


@register("M21_skipped_user_series", "series_key string, n_days long", f"""
SELECT series_key, count(*) AS n_days FROM ({S.daily_sql('ledger', 'CAST(user_id AS VARCHAR)')}) d
GROUP BY series_key HAVING count(*) < 30""")
def q_m21(t):
    led = t.ledger().withColumn("user_key", F.col("user_id").cast("string"))
    return FC.skipped_series(FC.daily_series(led, "user_key"))


@register("M22_project_per_category", FC_SPEC, S.project_sql(CAT_MODELS, 30))
def q_m22(t):
    return FC.project(cat_models(t), 30)


@register("M24_forecast_summary_total", "ds date, yhat double, yhat_lower double, yhat_upper double",
          f"SELECT ds, yhat, yhat_lower, yhat_upper FROM ({S.project_sql(TOT_MODELS, 30)}) f")
def q_m24(t):
    return FC.summary(FC.project(tot_models(t), 30)).drop("category")


@register("M25_available_series", "series_key string", f"SELECT DISTINCT series_key FROM ({CAT_MODELS}) m")
def q_m25(t):
    return FC.available_series(cat_models(t))


@register("M26_history_and_future_dates", "series_key string, ds date", f"""
SELECT series_key, CAST(ds AS TIMESTAMP) AS ds FROM ({CAT_DAILY}) d
UNION ALL
SELECT series_key, g.ds FROM (SELECT series_key, max(ds) AS m FROM ({CAT_DAILY}) d GROUP BY 1) x,
     unnest(generate_series(CAST(m AS TIMESTAMP) + INTERVAL 1 DAY, CAST(m AS TIMESTAMP) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS g(ds)""")
def q_m26(t):
    return FC.history_and_future_dates(cat_daily(t), 30)


@register("W9_last_7_daily_values", "series_key string, ds date, y double", f"""
SELECT series_key, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS rn
FROM ({CAT_DAILY}) d) r WHERE rn <= 7""")
def q_w9(t):
    from kassa.operators.windows import last_k
    return last_k(cat_daily(t), ["series_key"], 7)


@register("G23_training_horizon_end", "series_key string, train_ds_max date",
          f"SELECT series_key, max(ds) AS train_ds_max FROM ({CAT_DAILY}) d GROUP BY 1")
def q_g23(t):
    return FC.training_horizon_end(cat_daily(t))


@register("J7_series_model_match", "requested string, series_key string, match string", f"""
WITH m AS ({CAT_MODELS}),
req AS (SELECT DISTINCT category AS requested FROM ledger
        UNION SELECT DISTINCT replace(predicted_category, '-', ' ') FROM predictions_fixed
        UNION SELECT DISTINCT predicted_category || '!' FROM predictions_fixed),
ex AS (SELECT requested, series_key, 'exact' AS match FROM req JOIN m ON requested = series_key)
SELECT * FROM ex UNION ALL
SELECT requested, min(series_key), 'safe' FROM (SELECT * FROM req WHERE requested NOT IN (SELECT requested FROM ex)) r
JOIN m ON {S.SAFE_KEY.format(x='requested')} = m.safe_key GROUP BY requested""")
def q_j7(t):
    requested = (t.ledger().select("category")
                 .union(t.predictions_fixed().select(F.regexp_replace("predicted_category", "-", " ")))
                 .union(t.predictions_fixed().select(F.concat("predicted_category", F.lit("!")))))
    matched, _ = FC.match_models(requested, cat_models(t))
    return matched


@register("J7_unmatched_series", "requested string", f"""
WITH m AS ({CAT_MODELS}),
req AS (SELECT DISTINCT replace(predicted_category, '-', ' ') AS requested FROM predictions_fixed)
SELECT requested FROM req WHERE requested NOT IN (SELECT series_key FROM m)
  AND {S.SAFE_KEY.format(x='requested')} NOT IN (SELECT safe_key FROM m)""")
def q_j7u(t):
    requested = t.predictions_fixed().select(F.regexp_replace("predicted_category", "-", " ").alias("category"))
    _, unmatched = FC.match_models(requested, cat_models(t))
    return unmatched


HORIZON = f"SELECT * FROM ({S.project_sql(CAT_MODELS, 30)}) f WHERE ds > train_ds_max"


@register("G16_forecast_totals", "total_predicted double, total_lower double, total_upper double", f"""
SELECT sum(yhat) AS total_predicted, sum(yhat_lower) AS total_lower, sum(yhat_upper) AS total_upper
FROM ({S.project_sql(TOT_MODELS, 30)}) f WHERE ds > train_ds_max""")
def q_g16(t):
    return FC.forecast_totals(FC.project(tot_models(t), 30))


@register("G17_predicted_spend_per_category", "category string, predicted_spend double",
          f"SELECT category, sum(yhat) AS predicted_spend FROM ({HORIZON}) h GROUP BY 1")
def q_g17(t):
    return FC.predicted_by_category(FC.project(cat_models(t), 30))


@register("W10_forecast_horizon_tail", FC_SPEC, f"""
SELECT category, ds, yhat, yhat_lower, yhat_upper FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ds DESC) AS rn
FROM ({S.project_sql(CAT_MODELS, 30)}) f) r WHERE rn <= 30""")
def q_w10(t):
    from kassa.operators.windows import last_k
    return last_k(FC.project(cat_models(t), 30), ["category"], 30)


@register("T2_top_categories", "category string, predicted_spend double",
          f"SELECT category, sum(yhat) AS predicted_spend FROM ({HORIZON}) h GROUP BY 1 "
          "ORDER BY predicted_spend DESC, category LIMIT 3")
def q_t2(t):
    return FC.top_categories(FC.predicted_by_category(FC.project(cat_models(t), 30)), 3)


@register("T3_risk_category", "risk_category string, risk_amount double", f"""
SELECT coalesce(upper(arg_max(category, predicted_spend)), 'N/A') AS risk_category, coalesce(max(predicted_spend), 0) AS risk_amount
FROM (SELECT category, sum(yhat) AS predicted_spend FROM ({HORIZON}) h GROUP BY 1) p""")
def q_t3(t):
    return FC.risk_category(FC.predicted_by_category(FC.project(cat_models(t), 30)))


@register("T7_forecast_tail_20", FC_SPEC, f"""
SELECT category, ds, yhat, yhat_lower, yhat_upper FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ds DESC) AS rn
FROM ({S.project_sql(CAT_MODELS, 30)}) f) r WHERE rn <= 20""")
def q_t7(t):
    return FC.forecast_tail(FC.project(cat_models(t), 30), 20)


R1_SPEC = ("horizon_days long, total_predicted double, total_lower double, total_upper double, risk_category string, "
           "risk_amount double, " + ", ".join(f"top_{i}_category string, top_{i}_spend double" for i in range(1, 11)))


def _r1_sql(days: int) -> str:
    cat_h = f"SELECT * FROM ({S.project_sql(CAT_MODELS, days)}) f WHERE ds > train_ds_max"
    tops = ", ".join(f"max(category) FILTER (WHERE rk = {i}) AS top_{i}_category, "
                     f"max(spend) FILTER (WHERE rk = {i}) AS top_{i}_spend" for i in range(1, 11))
    return f"""
WITH tot AS (SELECT sum(yhat) AS total_predicted, sum(yhat_lower) AS total_lower, sum(yhat_upper) AS total_upper
             FROM ({S.project_sql(TOT_MODELS, days)}) f WHERE ds > train_ds_max),
per AS (SELECT category, spend, row_number() OVER (ORDER BY spend DESC, category) AS rk
        FROM (SELECT category, sum(yhat) AS spend FROM ({cat_h}) h GROUP BY 1) p),
top AS (SELECT coalesce(upper(max(category) FILTER (WHERE rk = 1)), 'N/A') AS risk_category,
               coalesce(max(spend) FILTER (WHERE rk = 1), 0) AS risk_amount, {tops} FROM per)
SELECT {days} AS horizon_days, * FROM tot, top"""


@register("R1_forecast_report", R1_SPEC, _r1_sql(30))
def q_r1(t):
    return R.forecast_report(FC.project(tot_models(t), 30), FC.project(cat_models(t), 30), 30)


DASHBOARD_SPEC = ("category string, predicted_spend double, rank long, share_pct double, total_predicted double, "
                  "total_lower double, total_upper double, is_risk boolean")


def dashboard_sql(days: int) -> str:
    return f"""
SELECT category, predicted_spend, row_number() OVER (ORDER BY predicted_spend DESC, category) AS rank,
       100.0 * predicted_spend / sum(predicted_spend) OVER () AS share_pct, total_predicted, total_lower, total_upper,
       row_number() OVER (ORDER BY predicted_spend DESC, category) = 1 AS is_risk
FROM (SELECT category, sum(yhat) AS predicted_spend FROM ({S.project_sql(CAT_MODELS, days)}) f
      WHERE ds > train_ds_max GROUP BY 1) p,
     (SELECT sum(yhat) AS total_predicted, sum(yhat_lower) AS total_lower, sum(yhat_upper) AS total_upper
      FROM ({S.project_sql(TOT_MODELS, days)}) g WHERE ds > train_ds_max) t"""


@register("R3_forecast_dashboard_90d",
          DASHBOARD_SPEC, dashboard_sql(90))
def q_r3(t):
    return R.dashboard_rows(FC.project(cat_models(t), 90), FC.project(tot_models(t), 90))


@register("M21_total_below_minimum", "fault string",
          "SELECT 'the total series has 1 days, 30 are needed' AS fault")
def q_m21_total(t):
    """The total series of one day of the ledger is refused."""
    day = t.ledger().agg(F.min(F.to_date("date")).alias("d"))
    one = t.ledger().join(F.broadcast(day), F.to_date("date") == F.col("d"))   # one row on the broadcast side
    try:
        FC.fit_total(FC.daily_series(one, None))
    except ValueError as e:
        return day.select(F.lit(str(e)).alias("fault"))
    raise AssertionError("a series of one day was accepted")


USER_DAILY = ("SELECT user_id, category, CAST(date AS DATE) AS ds, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS y "
              "FROM ledger GROUP BY 1, 2, 3")


@register("R4_user_forecast_response",
          "user_id long, days long, predicted_total double, daily_average double, top_category string, "
          "top_category_spend double, n_categories long, category string, category_spend double", f"""
WITH m AS ({S.fit_sql(USER_DAILY, 'user_id, category', 1, safe=False)}),
per AS (SELECT user_id, category, sum(yhat) AS spend FROM ({S.project_sql('SELECT * FROM m', 30, 'category', 'user_id, ')}) f
        WHERE ds > train_ds_max GROUP BY 1, 2)
SELECT r.*, per.category, per.spend AS category_spend FROM per JOIN (
  SELECT user_id, 30 AS days, sum(spend) AS predicted_total, sum(spend) / 30 AS daily_average,
         arg_min(category, (-spend, category)) AS top_category, max(spend) AS top_category_spend, count(*) AS n_categories
  FROM per GROUP BY user_id) r USING (user_id)""")
def q_r4(t):
    daily = daily_spend(t.ledger(), ["user_id", "category"])
    models = FC.fit_moving_average(daily, min_points=1, keys=["user_id", "category"])
    fc = FC.project(models, 30, key="category", keep=["user_id"])
    return R.user_forecast_response(fc, 30).select("*", F.explode("categories").alias("category", "category_spend"))


@register("M23_seasonal_trend_forecast", "category string, n_dates long, first_day date, last_day date, solved boolean, "
          "ordered boolean", f"""
SELECT series_key AS category, count(*) + 30 AS n_dates, min(ds) AS first_day, max(ds) + INTERVAL 30 DAY AS last_day,
       true AS solved, true AS ordered
FROM ({CAT_DAILY}) d GROUP BY 1 HAVING count(*) >= 30""")
def q_m23(t):
    """Per series: dates covered; the normal equations hold to 1e-6 of their size; lower <= yhat <= upper."""
    from kassa.operators.seasonal import fit_seasonal, forecast_seasonal, normal_residual
    daily = cat_daily(t)
    coef = materialise(fit_seasonal(daily), "seasonal")
    fc = forecast_seasonal(daily, coef, 30).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_dates"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
        F.bool_and((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered"))
    res = normal_residual(daily, coef).select("series_key", (F.col("residual") < 1e-6).alias("solved"))
    return fc.join(res, F.col("category") == F.col("series_key"))


PLANTED_SQL = f"""
SELECT series_key, ds, 100 + 40 * u + 200 * greatest(u - 0.4, 0) + (day * 7919 % 101 - 50) / 50.0 AS y
FROM (SELECT *, date_diff('day', first, ds) / greatest(date_diff('day', first, last), 1) AS u, date_diff('day', DATE '1970-01-01', ds) AS day
      FROM (SELECT series_key, CAST(ds AS DATE) AS ds, CAST(min(ds) OVER w AS DATE) AS first, CAST(max(ds) OVER w AS DATE) AS last
            FROM ({CAT_DAILY}) d WINDOW w AS (PARTITION BY series_key)) x) z"""


def planted_break(daily):
    """Series on the ledger's days whose slope rises from 40 to 240 at two fifths of their time."""
    spans = daily.groupBy("series_key").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    day = F.datediff("ds", F.lit("1970-01-01"))
    u = F.datediff("ds", "first") / F.greatest(F.datediff("last", "first"), F.lit(1))
    y = 100 + 40 * u + 200 * F.greatest(u - 0.4, F.lit(0.0)) + (day * 7919 % 101 - 50) / 50.0
    return daily.select("series_key", "ds").join(spans, "series_key").select("series_key", "ds", y.alias("y"))


@register("M23_trend_changes", "category string, n_days long, total double, found_there boolean, size_right boolean, quiet_elsewhere boolean", f"""
SELECT series_key AS category, count(*) AS n_days, sum(y) AS total, true AS found_there, true AS size_right, true AS quiet_elsewhere
FROM ({PLANTED_SQL}) p GROUP BY 1 HAVING count(*) >= 30""", digits=6)
def q_m23_changes(t):
    """Slope changes found in series with a planted break: one near two fifths of the time, of about the planted
    size (200 over the whole time), and no more than a fifth of that anywhere else."""
    from kassa.operators.seasonal import fit_seasonal, trend_changes
    daily = planted_break(cat_daily(t))
    coef = materialise(fit_seasonal(daily), "planted")
    near = F.abs(F.col("place") - 0.4) <= 0.08
    size = F.col("slope_change") * F.col("_span")
    changes = trend_changes(coef).join(coef.select("series_key", "_span"), "series_key").groupBy("series_key").agg(
        F.coalesce(F.sum(F.when(near, size)), F.lit(0.0)).alias("there"),
        F.coalesce(F.sum(F.when(~near, F.abs(size))), F.lit(0.0)).alias("elsewhere"))
    sums = daily.groupBy("series_key").agg(F.count(F.lit(1)).alias("n_days"), F.sum("y").alias("total"))
    return coef.select("series_key").join(sums, "series_key").join(changes, "series_key", "left").select(
        F.col("series_key").alias("category"), "n_days", "total", F.coalesce(F.col("there") > 0, F.lit(False)).alias("found_there"),
        F.coalesce(F.col("there").between(160, 240), F.lit(False)).alias("size_right"),
        F.coalesce(F.col("elsewhere") < 40, F.lit(False)).alias("quiet_elsewhere"))
