"""Edge cases of the ordered-sequence windows (FIXTURES.md section 3) and the chunk/halo split."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kassa.operators import sequence as seq
from kassa.operators import windows as W
from kassa.operators.features import build_all_features, engineer_features


def ts(s):
    return dt.datetime.fromisoformat(s)


def frame(spark, dates, amounts=None, user=1):
    amounts = amounts or [-1.0] * len(dates)
    data = [(i, user, ts(d), f"d{i}", float(a), "c") for i, (d, a) in enumerate(zip(dates, amounts))]
    return spark.createDataFrame(data, "transaction_id long, user_id long, date timestamp_ntz, description string, "
                                       "amount double, category string")


def test_count_7d_ties(spark):
    df = frame(spark, ["2024-01-01", "2024-01-08", "2024-01-08", "2024-01-09"])
    out = W.count_in_last_days(df, ["user_id"], 7).orderBy("transaction_id").collect()
    assert [r.transaction_count_7d for r in out] == [1, 1, 2, 3]


def test_days_since_last_subday(spark):
    df = frame(spark, ["2024-01-01T23:00", "2024-01-02T01:00", "2024-01-03T02:00"])
    out = W.days_since_last(df, ["user_id"]).orderBy("transaction_id").collect()
    assert [r.days_since_last for r in out] == [0, 0, 1]


def brute_rolling(pdf, n):
    pdf = pdf.sort_values(["user_id", "date", "transaction_id"])
    g = pdf.groupby("user_id")["amount_abs"]
    return (g.transform(lambda s: s.rolling(n, min_periods=1).mean()),
            g.transform(lambda s: s.rolling(n, min_periods=1).std()).fillna(0))


def test_chunk_halo_matches_pandas(spark):
    rng = np.random.default_rng(3)
    n = 400
    days = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60 * 24, n), unit="h")
    users = rng.choice([1, 2], size=n, p=[0.9, 0.1])   # one hot user
    pdf = pd.DataFrame({"transaction_id": np.arange(n), "user_id": users, "date": days.values,
                        "amount_abs": rng.uniform(1, 100, n).round(2)})
    df = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = W.rolling_stats(df, ["user_id"], "amount_abs", chunk_rows=40).toPandas().sort_values("transaction_id")
    m7, s7 = brute_rolling(pdf, 7)
    m30, s30 = brute_rolling(pdf, 30)
    exp = pdf.assign(m7=m7, s7=s7, m30=m30, s30=s30).sort_values("transaction_id")
    assert np.allclose(got.rolling_7d_mean, exp.m7) and np.allclose(got.rolling_7d_std, exp.s7)
    assert np.allclose(got.rolling_30d_mean, exp.m30) and np.allclose(got.rolling_30d_std, exp.s30)


def test_count_7d_matches_pandas_rolling(spark):
    rng = np.random.default_rng(5)
    n = 300
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40 * 24 * 60, n)), unit="min")
    t = t[rng.permutation(n)]
    t = pd.DatetimeIndex(list(t[:250]) + list(t[:50]))  # exact duplicates
    pdf = pd.DataFrame({"transaction_id": np.arange(n), "date": t, "amount": -1.0})
    s = pdf.sort_values(["date", "transaction_id"]).set_index("date")
    exp = s["amount"].rolling("7D").count().values
    df = spark.createDataFrame(pdf.assign(user_id=1)).withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = W.count_in_last_days(df, ["user_id"], 7).toPandas().sort_values(["date", "transaction_id"])
    assert list(got.transaction_count_7d) == list(exp.astype(int))


def test_rank_spans_days(spark):
    df = frame(spark, ["2024-01-01", "2024-01-01", "2024-01-03", "2024-02-01"])
    out = seq.sequence(df, ["user_id"]).orderBy("transaction_id").collect()
    assert [r[seq.RANK] for r in out] == [1, 2, 3, 4]
    assert [r[seq.DAY_RANK] for r in out] == [1, 2, 1, 1]


def test_first_row_std_zero_and_single_row_month(spark):
    df = frame(spark, ["2024-01-01", "2024-02-01"], [-5.0, 7.0])
    tr = build_all_features(df, categories=["c"]).orderBy("transaction_id").collect()
    assert tr[0].rolling_7d_std == 0.0 and tr[0].monthly_std is None
    sv = engineer_features(df).orderBy("transaction_id").collect()
    assert sv[0].monthly_std == 0.0
    assert tr[1].monthly_expense == 0.0 and tr[1].income_expense_ratio == 7.0


def test_null_key_is_its_own_group(spark):
    # the null stand-in value equals a real key (0 / ''); the is-null flag keeps them apart
    rows = [(0, None, "2024-01-01"), (1, 0, "2024-01-02"), (2, None, "2024-01-03"),
            (3, 0, "2024-01-20"), (4, None, "2024-01-05"), (5, 1, "2024-01-05")]
    for kt, conv in (("long", lambda u: u), ("string", lambda u: None if u is None else ("" if u == 0 else str(u)))):
        data = [(i, conv(u), ts(d), f"d{i}", -1.0, "c") for i, u, d in rows]
        df = spark.createDataFrame(data, f"transaction_id long, user_id {kt}, date timestamp_ntz, "
                                         "description string, amount double, category string")
        out = {r.transaction_id: r for r in seq.sequence(df, ["user_id"], lookback_days=7, count_name="n7").collect()}
        assert [out[i][seq.RANK] for i in range(6)] == [1, 1, 2, 2, 3, 1]
        assert [out[i].n7 for i in range(6)] == [1, 1, 2, 1, 3, 1]
        assert out[2][seq.PREV_TS] == ts("2024-01-01") and out[1][seq.PREV_TS] is None


def test_attach_joins_per_key_month_with_null_keys(spark):
    rows = [(0, None, "2024-01-01"), (1, 0, "2024-01-02"), (2, None, "2024-02-03"), (3, 0, "2024-01-20")]
    data = [(i, u, ts(d), f"d{i}", -1.0, "c") for i, u, d in rows]
    df = spark.createDataFrame(data, "transaction_id long, user_id long, date timestamp_ntz, "
                                     "description string, amount double, category string")
    table = spark.createDataFrame([(None, "2024-01", 10.0), (0, "2024-01", 20.0), (None, "2024-02", 30.0)],
                                  "user_id long, year_month string, v double")
    out = seq.sequence(df, ["user_id"], attach=(table, {"year_month": F.date_format(F.col("_day"), "yyyy-MM")}))
    got = {r.transaction_id: r.v for r in out.collect()}
    assert got == {0: 10.0, 1: 20.0, 2: 30.0, 3: 20.0}
    assert out.columns[-1] == "v" and "year_month" not in out.columns


def test_one_day_of_one_key_spreads_over_tasks(spark):
    """Half of all rows belong to one key and one day: no window partition holds more than a part of them."""
    day = dt.datetime(2024, 1, 1)
    hot = spark.range(20_000).selectExpr("id AS transaction_id", "1L AS user_id")
    cold = spark.range(20_000, 40_000).selectExpr("id AS transaction_id", "id % 500 AS user_id")
    df = hot.unionByName(cold).withColumn("date", F.lit(day).cast("timestamp_ntz"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = seq.sequence(df, ["user_id"])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 6 and max(sizes) < 15_000
    ranks = out.where("user_id = 1").agg(F.min(seq.RANK), F.max(seq.RANK), F.count_distinct(seq.RANK),
                                         F.max(seq.DAY_RANK)).first()
    assert tuple(ranks) == (1, 20_040, 20_040, 20_040)


def _hot_ledger(spark, n=1500):
    rng = np.random.default_rng(11)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 90 * 24, n), unit="h")
    users = rng.choice([1, 2, 3, 4], size=n, p=[0.7, 0.2, 0.07, 0.03])
    rows = [(i, None if u == 4 else int(u), None if i % 90 == 7 else ts_.to_pydatetime(), f"word {i % 5}", float(a), "ab"[i % 2])
            for i, (u, ts_, a) in enumerate(zip(users, t, rng.normal(0, 50, n).round(2)))]
    rows += [(5, 1, ts("2024-01-20"), "twice", -1.0, "a"), (5, 1, ts("2024-01-20"), "again", -2.0, "a")]
    return spark.createDataFrame(rows, "transaction_id long, user_id long, date timestamp_ntz, description string, "
                                       "amount double, category string")


def test_small_parts_give_the_same_features(spark):
    """Keys and days that reach over many parts: carries, border rows and monthly groups against one part."""
    df = _hot_ledger(spark)
    for build, kw in ((build_all_features, {"categories": ["a", "b"]}), (engineer_features, {})):
        whole = build(df, **kw).toPandas()
        split = build(df, chunk_rows=31, **kw).toPandas()[whole.columns]
        order = ["transaction_id", "description"]
        pd.testing.assert_frame_equal(whole.sort_values(order, ignore_index=True), split.sort_values(order, ignore_index=True),
                                      rtol=1e-9, atol=1e-9)


def test_previous_time_without_border_rows(spark):
    df = _hot_ledger(spark)
    a, b = (seq.sequence(df, ["user_id"], lookback_days=7, count_name="n", chunk_rows=c).toPandas() for c in (1 << 20, 10))
    order = ["transaction_id", "description"]
    pd.testing.assert_frame_equal(a.sort_values(order, ignore_index=True), b.sort_values(order, ignore_index=True))


def test_whole_rows_are_exchanged_once(spark):
    """After its input is written, E1 moves ``description`` through one exchange: the join with its features."""
    df = _hot_ledger(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build_all_features(df, categories=["a", "b"], feature_set="no_label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    wide = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and "description" in "".join(lines[i + 1: i + 4])]
    assert len(wide) == 1
    assert sum("Exchange hashpartitioning" in x for x in lines) == 3  # rows, features, windows of the features
