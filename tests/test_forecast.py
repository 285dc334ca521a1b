import datetime as dt

from pyspark.sql import functions as F

from kassa.operators import forecast as FC


def ledger(spark, days, amount=-10.0, cat="food"):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i), amount, cat) for i in range(days)]
    return spark.createDataFrame(rows, "transaction_id long, date timestamp_ntz, amount double, predicted_category string")


def test_gate_29_skipped_30_trained(spark):
    df = ledger(spark, 29, cat="a").unionByName(ledger(spark, 30, cat="b"))
    daily = FC.daily_series(df)
    assert [r.series_key for r in FC.fit_moving_average(daily).collect()] == ["b"]
    assert [(r.series_key, r.n_days) for r in FC.skipped_series(daily).collect()] == [("a", 29)]


def test_projection_has_days_plus_one_rows_and_bands(spark):
    m = FC.fit_moving_average(FC.daily_series(ledger(spark, 40)))
    fc = FC.project(m, 3).orderBy("ds").collect()
    assert len(fc) == 4 and fc[0].ds == fc[0].train_ds_max
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)
    tot = FC.forecast_totals(FC.project(m, 3)).first()
    assert tot.total_predicted == 30.0


def test_income_only_day_kept_with_zero(spark):
    df = ledger(spark, 1, amount=5.0)
    r = FC.daily_series(df).first()
    assert r.y == 0.0


def test_missing_category_column_is_all(spark):
    df = ledger(spark, 31).drop("predicted_category")
    assert [r.series_key for r in FC.fit_moving_average(FC.daily_series(df)).collect()] == ["all"]


def test_risk_empty_is_na(spark):
    empty = spark.createDataFrame([], "category string, predicted_spend double")
    r = FC.risk_category(empty).first()
    assert (r.risk_category, r.risk_amount) == ("N/A", 0.0)


def test_seasonal_trend_matches_numpy_ridge(spark):
    import math
    import numpy as np
    from kassa.operators.seasonal import fit_seasonal, forecast_seasonal, n_terms
    base = dt.date(2024, 1, 1)
    n = 120
    rng = np.random.default_rng(0)
    y = [10 + 0.05 * i + 3 * math.sin(2 * math.pi * (base + dt.timedelta(days=i)).toordinal() / 7)
         + rng.normal(0, 0.1) for i in range(n)]
    daily = spark.createDataFrame([("s", base + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)],
                                  "series_key string, ds date, y double")
    coef = fit_seasonal(daily, ridge=1e-6)
    fc = forecast_seasonal(daily, coef, days=10).orderBy("ds").toPandas()
    assert len(fc) == n + 10
    assert (fc.yhat_lower <= fc.yhat).all() and (fc.yhat <= fc.yhat_upper).all()
    resid = np.array(y) - fc.yhat.values[:n]
    assert np.sqrt(np.mean(resid ** 2)) < 0.2          # recovers trend + weekly shape
    assert coef.first().beta.__len__() == n_terms()


def test_dashboard_ranks_every_category(spark):
    from kassa.operators.reports import dashboard_rows
    trained, day = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    spec = "category string, ds date, train_ds_max date, yhat double, yhat_lower double, yhat_upper double"
    per = spark.createDataFrame([(f"c{i:03d}", day, trained, float(i // 2), 0.0, 0.0) for i in range(250)], spec)
    total = spark.createDataFrame([("all", day, trained, 7.0, 6.0, 8.0)], spec)
    got = {r["category"]: (r["rank"], r["is_risk"]) for r in dashboard_rows(per, total).collect()}
    want = sorted(range(250), key=lambda i: (-(i // 2), i))
    assert got == {f"c{i:03d}": (n, n == 1) for n, i in enumerate(want, 1)}


def _daily(spark, values, first="2023-01-01", name="s"):
    base = dt.date.fromisoformat(first)
    return spark.createDataFrame([(name, base + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 "series_key string, ds date, y double")


def test_cross_products_are_sums_over_rows(spark):
    import numpy as np
    from kassa.operators import seasonal as S
    rng = np.random.default_rng(1)
    daily = _daily(spark, rng.normal(5, 2, 300)).unionByName(_daily(spark, rng.normal(1, 2, 40), "1971-03-01", "t")).unionByName(
        _daily(spark, [9.0] * 40, "2024-06-01", "t"))
    spans = daily.groupBy("series_key").agg(F.min(S.days_since_epoch(F.col("ds"))).alias("_day0"), F.lit(400.0).alias("_span"), F.lit(2.0).alias("_scale"))
    d = S._with_design(daily, spans)
    got = {r["series_key"]: np.array(r["sums"]) for r in S.cross_products(d.repartition(7)).collect()}
    for name in ("s", "t"):
        z = np.array([[*r["_x"], r["y"] / 2] for r in d.where(F.col("series_key") == name).collect()])
        assert np.allclose(got[name], (z.T @ z).ravel(), rtol=1e-9, atol=1e-6)


def test_descent_finds_the_minimum():
    import numpy as np
    from kassa.operators.seasonal import descend
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = np.cumsum(rng.normal(size=(60, 8)), axis=1)
        m, c = a.T @ a, a.T @ rng.normal(size=60)
        for penalty in (0.0, 0.1, 3.0, 1e6):
            x = descend(m, c, penalty)
            g = c - m @ x
            assert (np.abs(g[x != 0] - penalty * np.sign(x[x != 0])) < 1e-6).all() and (np.abs(g) <= penalty + 1e-6).all()


def test_planted_changes_are_found_and_intervals_widen(spark):
    import numpy as np
    from kassa.operators.seasonal import fit_seasonal, forecast_seasonal, normal_residual, trend_changes
    rng = np.random.default_rng(3)
    t = np.arange(1500)  # several years, so that a year's curve cannot stand in for the break
    daily = _daily(spark, 50 + 0.1 * t + 1.0 * np.maximum(t - 600, 0) + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 15, 1500))
    coef = fit_seasonal(daily).cache()
    assert normal_residual(daily, coef).first()["residual"] < 1e-6
    changes = trend_changes(coef).collect()
    near = [c["slope_change"] for c in changes if abs(c["place"] - 0.4) < 0.08]
    assert abs(sum(near) - 1.0) < 0.1 and sum(abs(c["slope_change"]) for c in changes) - sum(near) < 0.2
    fc = forecast_seasonal(daily, coef, 60).orderBy("ds").toPandas()
    width = (fc.yhat_upper - fc.yhat_lower).to_numpy()
    assert width[-1] > 2 * width[0] and abs(fc.yhat.iloc[-1] - (50 + 155.9 + 959)) < 60
    again = forecast_seasonal(daily.repartition(5), coef, 60).orderBy("ds").toPandas()
    assert np.allclose(again.yhat_upper, fc.yhat_upper, rtol=1e-12)


def test_time_of_day_has_its_own_terms(spark):
    import numpy as np
    from kassa.operators.seasonal import fit_seasonal, forecast_seasonal
    base = dt.datetime(2024, 1, 1)
    rows = [("s", base + dt.timedelta(hours=6 * i), 10.0 + (4.0 if i % 4 == 2 else 0.0)) for i in range(480)]
    daily = spark.createDataFrame(rows, "series_key string, ds timestamp, y double")
    fc = forecast_seasonal(daily, fit_seasonal(daily), 4).orderBy("ds").toPandas()
    assert np.abs(fc.yhat.to_numpy()[:480] - np.array([r[2] for r in rows])).max() < 0.1
