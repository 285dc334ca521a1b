"""Anomaly scoring on the metric matrix (M13, M14, M16-M18, G19, G22, T1, P8, F16) with a
fixed linear decoder (SQL-checkable), plus R2 which combines forecasts and anomalies."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.operators import anomaly as A
from kassa.operators import forecast as FC
from kassa.operators import reports as R
from kassa.plans.q_forecast import CAT_MODELS, TOT_MODELS, cat_models, tot_models
from kassa.plans import sqlfrag as S
from kassa.plans.registry import register
from kassa.sources.testdata import METRIC_FEATURES

D = METRIC_FEATURES
COLS = [f"feature_{i}" for i in range(D)]


def scored(t, threshold=None):
    m = A.align_for_scoring(t.metrics(), COLS)
    scaler = A.fit_scaler(m, COLS)
    return A.detect(m, scaler, A.neighbour_decoder(D), threshold=threshold)


def _std(c):
    return f"CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1 ELSE stddev_pop({c}) OVER () END"


SCALED_SQL = ("SELECT row_id, " + ", ".join(COLS) + ", " + ", ".join(
    f"({c} - avg({c}) OVER ()) / {_std(c)} AS {c}_scaled" for c in COLS) + " FROM metrics")
RECON_SQL = ("SELECT *, " + ", ".join(
    f"{COLS[j]}_scaled * 0.5 + {COLS[(j + 1) % D]}_scaled * 0.5 AS {COLS[j]}_recon" if j + 1 < D else
    f"{COLS[0]}_scaled * 0.5 + {COLS[j]}_scaled * 0.5 AS {COLS[j]}_recon" for j in range(D)) + f" FROM ({SCALED_SQL}) s")
ERR_SQL = ("SELECT *, (" + " + ".join(f"pow({c}_scaled - {c}_recon, 2)" for c in COLS)
           + f") / {float(D)} AS reconstruction_error FROM ({RECON_SQL}) r")
SCORED_SQL = (f"SELECT e.*, reconstruction_error > thr AS is_anomaly, CASE WHEN reconstruction_error > thr "
              f"THEN 'anomaly' ELSE 'normal' END AS anomaly_label, thr AS threshold FROM ({ERR_SQL}) e, "
              f"(SELECT quantile_cont(reconstruction_error, 0.95) AS thr FROM ({ERR_SQL}) e2) q")
SCORED_SPEC = "row_id long, reconstruction_error double, threshold double, is_anomaly boolean, anomaly_label string"


@register("M13_standard_scaling", "row_id long, " + ", ".join(f"{c}_scaled double" for c in COLS), SCALED_SQL)
def q_m13(t):
    m = A.align_for_scoring(t.metrics(), COLS)
    return A.scale(m, A.fit_scaler(m, COLS))


@register("M14_align_pad_features", "row_id long, " + ", ".join(f"{c} double" for c in COLS),
          "SELECT row_id, " + ", ".join(COLS[:-2]) + ", " + ", ".join(f"0.0 AS {c}" for c in COLS[-2:]) + " FROM metrics")
def q_m14(t):
    fewer = t.metrics().select("row_id", *[F.col(c).alias(f"f{i}") for i, c in enumerate(COLS[:-2])])
    return A.align_for_scoring(fewer, COLS)


@register("M16_M17_detect_anomalies", SCORED_SPEC, SCORED_SQL)
def q_m16(t):
    return scored(t)


@register("G19_error_percentile_95", "threshold double",
          f"SELECT quantile_cont(reconstruction_error, 0.95) AS threshold FROM ({ERR_SQL}) e")
def q_g19(t):
    m = A.align_for_scoring(t.metrics(), COLS)
    s = A.score_linear(m, A.fit_scaler(m, COLS), A.neighbour_decoder(D))
    thr = A.exact_quantile(s, "reconstruction_error", 0.95)
    return s.groupBy().agg(F.lit(thr).alias("threshold"))


@register("M17_fixed_threshold", SCORED_SPEC,
          f"SELECT *, reconstruction_error > 1.0 AS is_anomaly, CASE WHEN reconstruction_error > 1.0 THEN 'anomaly' "
          f"ELSE 'normal' END AS anomaly_label, 1.0 AS threshold FROM ({ERR_SQL}) e")
def q_m17(t):
    return scored(t, threshold=1.0)


@register("G22_anomaly_counts", "n_flagged long, n_total long, pct_flagged double",
          f"SELECT count(*) FILTER (WHERE is_anomaly) AS n_flagged, count(*) AS n_total, "
          f"100.0 * count(*) FILTER (WHERE is_anomaly) / count(*) AS pct_flagged FROM ({SCORED_SQL}) s")
def q_g22(t):
    from kassa.operators.aggregates import flag_counts
    return flag_counts(scored(t))


@register("P8_anomalous_rows", SCORED_SPEC, f"SELECT * FROM ({SCORED_SQL}) s WHERE is_anomaly")
def q_p8(t):
    from kassa.operators.filters import anomalous
    return anomalous(scored(t))


@register("T1_top_anomalies", SCORED_SPEC,
          f"SELECT * FROM ({SCORED_SQL}) s WHERE is_anomaly ORDER BY reconstruction_error DESC, row_id LIMIT 10")
def q_t1(t):
    return A.top_anomalies(scored(t), 10)


@register("M18_feature_contributions",
          "row_id long, feature string, original_value double, scaled_value double, reconstructed_scaled double, "
          "squared_error double, contribution_pct double", f"""
WITH s AS ({SCORED_SQL}),
l AS (""" + " UNION ALL ".join(
              f"SELECT row_id, '{c}' AS feature, {c} AS original_value, {c}_scaled AS scaled_value, "
              f"{c}_recon AS reconstructed_scaled, pow({c}_scaled - {c}_recon, 2) AS squared_error FROM s WHERE is_anomaly"
              for c in COLS) + """)
SELECT *, 100.0 * squared_error / sum(squared_error) OVER (PARTITION BY row_id) AS contribution_pct FROM l""")
def q_m18(t):
    return A.contributions(scored(t).filter(F.col("is_anomaly")), COLS)


@register("R2_executive_report",
          "horizon_days long, total_predicted double, risk_category string, risk_amount double, "
          "n_category_series long, n_anomalies long, n_scored long", f"""
WITH tot AS (SELECT sum(yhat) AS total_predicted FROM ({S.project_sql(TOT_MODELS, 30)}) f WHERE ds > train_ds_max),
per AS (SELECT category, sum(yhat) AS spend FROM ({S.project_sql(CAT_MODELS, 30)}) f WHERE ds > train_ds_max GROUP BY 1),
an AS (SELECT count(*) FILTER (WHERE is_anomaly) AS n_anomalies, count(*) AS n_scored FROM ({SCORED_SQL}) s)
SELECT 30 AS horizon_days, total_predicted,
       coalesce(upper((SELECT arg_min(category, (-spend, category)) FROM per)), 'N/A') AS risk_category,
       coalesce((SELECT max(spend) FROM per), 0) AS risk_amount, (SELECT count(*) FROM per) AS n_category_series,
       n_anomalies, n_scored FROM tot, an""")
def q_r2(t):
    return R.executive_report(FC.project(tot_models(t), 30), FC.project(cat_models(t), 30), scored(t), 30)


@register("R2_executive_report_series", "category string, ds date, yhat double, yhat_lower double, yhat_upper double, share_pct double", f"""
WITH f AS (SELECT * FROM ({S.project_sql(CAT_MODELS, 30)}) f0 WHERE ds > train_ds_max)
SELECT category, ds, yhat, yhat_lower, yhat_upper, 100.0 * yhat / sum(yhat) OVER (PARTITION BY ds) AS share_pct FROM f""")
def q_r2_series(t):
    return R.executive_series(FC.project(cat_models(t), 30))
