"""Bucketed tables and labels in any number."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kassa.operators import features as FE
from kassa.operators import joins as J
from kassa.operators import labels as L
from kassa.operators import windows as W
from kassa.sources.bucketed import drop_bucketed, new_name, save_bucketed
from kassa.sources.testdata import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    names = [new_name("ledger"), new_name("users")]
    rows = save_bucketed(t.ledger(), names[0], "user_id", 4, str(tmp_path / "a"))
    users = save_bucketed(t.users(), names[1], "id", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, monthly = J.with_owner(rows, users), W.monthly_inside_buckets(rows, ["user_id"])
        for df in (joined, monthly, FE.monthly_stats(rows, ["user_id"])):
            assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)
        plain = J.with_owner(t.ledger(), t.users())
        assert "Exchange" in plan_of(plain)
        assert sorted(joined.select("transaction_id", "email").collect()) == sorted(plain.select("transaction_id", "email").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            drop_bucketed(spark, n)
    assert not spark.catalog.tableExists(names[0])


def labelled(spark, n=5000):
    return spark.range(n).select("id", F.when(F.col("id") % 7 != 0, F.format_string("label %04d", F.col("id") % 1500)).alias("category"))


def test_more_labels_than_columns_could_hold(spark):
    df = labelled(spark)
    with pytest.raises(ValueError, match="distinct values"):
        FE.category_values(df)
    dictionary = L.label_dictionary(df)
    rows = dictionary.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows))) and [r["label"] for r in rows] == sorted(r["label"] for r in rows)
    place = {r["label"]: r["index"] for r in rows}
    out = L.one_hot_vector(df, dictionary).select("id", "category", "label_vector").collect()
    assert len(out) == 5000
    for r in out:
        v = r["label_vector"]
        assert v.size == len(rows) and list(v.indices) == ([] if r["category"] is None else [place[r["category"]]])
    entries = L.with_label_index(df, dictionary).select("category", L.one_hot_entry(len(rows)).alias("e")).collect()
    assert all(list(r["e"]["indices"]) == ([] if r["category"] is None else [place[r["category"]]]) for r in entries)


def test_new_labels_have_no_entry(spark):
    dictionary = L.label_dictionary(spark.createDataFrame([("a",), ("b",), (None,)], "category string"))
    new = spark.createDataFrame([("b",), ("c",), (None,)], "category string")
    got = L.assemble(L.one_hot_vector(new, dictionary).withColumn("x", F.lit(2.5)), ["x"], ["label_vector"])
    assert sorted(got.select(vector_to_array("features")).collect()) == [([2.5, 0.0, 0.0],), ([2.5, 0.0, 0.0],), ([2.5, 0.0, 1.0],)]
    nothing = L.label_dictionary(new.limit(0))
    assert [r[0].size for r in L.one_hot_vector(new, nothing).select("label_vector").collect()] == [0, 0, 0]


def test_features_with_sparse_labels(spark):
    t = Tables(spark, SF_SMALL)
    columns = FE.build_all_features(t.ledger())
    sparse = FE.build_all_features(t.ledger(), sparse_labels=True)
    names = [c for c in columns.columns if c.startswith("cat_is_")]
    assert names and not [c for c in sparse.columns if c.startswith("cat_is_")]
    a = columns.select("transaction_id", F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("v"))
    b = sparse.select("transaction_id", vector_to_array("label_vector").alias("v"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_many_labels_are_read_back_without_their_zeros(spark):
    """A dense copy of each of these vectors would be 2^31 - 1 numbers long."""
    df = spark.range(200).select("id", (F.col("id") - 100).cast("double").alias("x"), F.lit(2).alias("_index"))
    size = (1 << 31) - 2
    vector = df.withColumn("label_vector", L._vector(L.one_hot_entry(size, "_index"), size))
    out = L.assemble(vector, ["x"], ["label_vector"])
    got = out.select("id", L.vector_entries("features").alias("e")).collect()
    assert out.schema["label_vector"].metadata == {"ml_attr": {"num_attrs": size}}
    for r in got:
        own = [(0, r["id"] - 100.0)] if r["id"] != 100 else []
        assert r["e"]["size"] == size + 1 and [tuple(e) for e in r["e"]["entries"]] == own + [(3, 1.0)]


def test_label_vectors_carry_no_attribute_per_label(spark):
    df = labelled(spark)
    out = L.assemble(L.one_hot_vector(df, L.label_dictionary(df)).withColumn("x", F.lit(1.0)), ["x"], ["label_vector"])
    assert all(len(str(out.schema[c].metadata)) < 100 for c in ("label_vector", "features"))


def test_entries_of_dense_vectors_and_errors(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([0.0, 3.0]), 1.0), (Vectors.dense([]), 2.0)], ["v", "x"])
    got = [(r[0]["size"], [tuple(e) for e in r[0]["entries"]]) for r in df.select(L.vector_entries("v")).collect()]
    assert got == [(2, [(1, 3.0)]), (0, [])]
    whole = [r[0].toArray().tolist() for r in L.assemble(df, ["x"], ["v"]).select("features").collect()]
    assert whole == [[1.0, 0.0, 3.0], [2.0]]
    with pytest.raises(Exception, match="not a number"):
        L.assemble(df.withColumn("x", F.lit(float("nan"))), ["x"], ["v"]).collect()
