from pyspark.sql import functions as F

from kassa.functions import safe_key, transaction_size, word_count, is_valid_email
from kassa.operators.clean import clean_transactions


def test_size_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 10.0, 10.01, 50.0, 100.0, 500.0, 501.0]], "a double")
    got = [r[0] for r in df.select(transaction_size(F.col("a"))).collect()]
    assert got == [None, "tiny", "small", "small", "medium", "large", "huge"]


def test_safe_key_and_words(spark):
    df = spark.createDataFrame([("Food & Dining!", "  a  b\tc "), ("__", "")], "c string, d string")
    got = df.select(safe_key(F.col("c")), word_count(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("Food___Dining", 3), ("category", 0)]


def test_email(spark):
    df = spark.createDataFrame([("a.b@x.org",), ("nope",), (None,)], "e string")
    assert [r[0] for r in df.select(is_valid_email(F.col("e"))).collect()] == [True, False, False]


def test_clean_drops_and_dedupes(spark):
    df = spark.createDataFrame(
        [(" 2024-01-05", "  Coffee\t", "-3.5"), ("bad", "x", "1"), ("2024-01-05", "COFFEE", "-3.5"),
         ("2024-01-06", None, "2"), ("2024-01-07", "y", "NaN")],
        "` Date ` string, Description string, AMOUNT string")
    out = clean_transactions(df).collect()
    assert len(out) == 1 and out[0].description == "coffee" and out[0].amount == -3.5
