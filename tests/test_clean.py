import datetime as dt

import pytest
from pyspark.sql import functions as F

from kassa.operators import clean as C
from kassa.operators import windows as W
from kassa.sources.files import latest_snapshot, load_transactions, newest_root


def test_amounts_are_plain_decimals(spark):
    values = {"12.5": 12.5, " -3 ": -3.0, "+.5": 0.5, "1e3": 1000.0, "1d": None, "12.5F": None, "0x1p3": None,
              "inf": None, "-Infinity": None, "NaN": None, "": None, "1,000": None, "1e999": None, None: None}
    df = spark.createDataFrame([(k,) for k in values], "a string")
    got = {r["a"]: r["v"] for r in df.select("a", C.coerce_double(F.col("a"), df.schema["a"].dataType).alias("v")).collect()}
    assert got == values


def test_common_date_layouts(spark):
    day = dt.datetime(2024, 3, 5)
    values = {"2024-03-05": day, "03/05/2024": day, "3/5/2024": day, "2024/03/05": day, "20240305": day, "Mar 5, 2024": day,
              "5 Mar 2024": day, "2024-03-05 06:07:08": day.replace(hour=6, minute=7, second=8), "13/13/2024": None, "x": None}
    df = spark.createDataFrame([(k,) for k in values], "a string")
    assert {r["a"]: r["v"] for r in df.select("a", C.parse_timestamp(F.col("a")).alias("v")).collect()} == values
    day_first = df.select(C.parse_timestamp(F.lit("25-12-2024"), ["dd-MM-yyyy"]).alias("v")).first()["v"]
    assert day_first == dt.datetime(2024, 12, 25)


def test_required_columns_name_every_fault(spark):
    df = spark.createDataFrame([(1, [1.0])], "description int, amount array<double>")
    with pytest.raises(ValueError, match="'date' absent.*'amount' is a array"):
        C.require_columns(df)


def test_newest_snapshot_is_read_whole(spark, tmp_path):
    import os
    for name, n, when in (("t_1", 30, 1_000), ("t_2", 50, 2_000)):
        spark.range(n).repartition(5).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).iterdir():
            os.utime(f, (when, when))
    assert newest_root(spark, str(tmp_path / "t_*")).endswith("t_2")
    assert latest_snapshot(spark, str(tmp_path / "t_*"), fmt="parquet").count() == 50
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, str(tmp_path / "none_*"))


def test_csv_with_us_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,amount\n03/05/2024,1\nbad,2\n")
    assert [r["Date"] for r in load_transactions(spark, str(tmp_path / "a.csv")).collect()] == [dt.datetime(2024, 3, 5), None]


def test_rows_without_a_date_stay(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [(1, 1, None, 5.0), (2, 1, d, 6.0), (3, 1, d + dt.timedelta(days=2), 7.0), (4, None, None, 1.0)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, date timestamp_ntz, amount_abs double")
    gaps = {r["transaction_id"]: r["days_since_last"] for r in W.days_since_last(df, ["user_id"]).collect()}
    assert gaps == {1: 0, 2: 0, 3: 2, 4: 0}
    counts = {r["transaction_id"]: r["transaction_count_7d"] for r in W.count_in_last_days(df, ["user_id"]).collect()}
    assert counts == {1: None, 2: 1, 3: 2, 4: None}
    assert W.rolling_stats(df, ["user_id"]).count() == 4


def test_every_row_has_its_position_by_date(spark):
    rows = [(i, None if i % 7 == 0 else f"2024-01-{1 + i * 5 % 28:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "transaction_id long, date string").withColumn("date", F.col("date").cast("timestamp"))
    got = {r["transaction_id"]: r["pos"] for r in C.date_positions(df.repartition(5)).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert got == {i: n for n, (i, _) in enumerate(want, 1)}


def test_layout_shapes():
    assert C.layout_shape("MM/dd/yyyy") == r"^\d{2}/\d{2}/\d{4}$" and C.layout_shape("EEE d") is None
    assert all(C.layout_shape(f) for f in C.DATE_FORMATS)


def test_layouts_of_one_shape_are_tried_in_order(spark):
    df = spark.createDataFrame([("25/12/2024",), ("01/02/2024",), ("1/2/2024",)], "a string")
    got = [r[0] for r in df.select(C.parse_timestamp(F.col("a"), ["MM/dd/yyyy", "d/M/yyyy"])).collect()]
    assert got == [dt.datetime(2024, 12, 25), dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1)]
