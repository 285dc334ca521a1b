import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kassa.operators import classify as CL
from kassa.operators.clean import clean_transactions
from kassa.operators.features import build_all_features
from kassa.sources.testdata import Tables
from kassa.streaming.ledger_stream import RAW_LEDGER_SCHEMA, daily_spend_stream


def test_stratified_split_exact_counts(spark):
    led = Tables(spark, SF_SMALL).ledger_learnable()
    s = CL.stratified_split(led, digits=2)
    per = {r.category: (r.n, r.t) for r in s.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == int(n * 0.2 + 0.5) for n, t in per.values())


def test_forest_quality_floor_without_label_features(spark):
    led = clean_transactions(Tables(spark, SF_SMALL).ledger_learnable())
    data = CL.stratified_split(build_all_features(led, feature_set="no_label", categories=[])).persist()
    feats = CL.model_features("no_label")
    model = CL.fit(data.where(~F.col("is_test")), feats, num_trees=30)
    pred = CL.predict(model, data.where(F.col("is_test")))
    acc = pred.agg(F.avg((F.col("category") == F.col("predicted_category")).cast("double"))).first()[0]
    assert acc > 0.9
    assert pred.count() == data.where(F.col("is_test")).count()
    assert set(model.labels) == {"Bills & Utilities", "Food & Dining", "Income", "Shopping"}


def test_daily_spend_stream_matches_batch(spark, tmp_path):
    rows = [(i, 1, (dt.date(2024, 1, 1) + dt.timedelta(days=i % 5)).isoformat(), "x", str(-1.0 - i), "c")
            for i in range(50)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, RAW_LEDGER_SCHEMA).write.parquet(str(src))
    raw = spark.readStream.schema(RAW_LEDGER_SCHEMA).parquet(str(src))
    q = (daily_spend_stream(raw).writeStream.format("memory").queryName("daily_spend_test")
         .outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.ds.date(): r.y for r in spark.sql("SELECT * FROM daily_spend_test").collect()}
    exp = {}
    for i, _, d, _, a, _ in rows:
        exp[dt.date.fromisoformat(d)] = exp.get(dt.date.fromisoformat(d), 0.0) - float(a)
    assert got == exp
