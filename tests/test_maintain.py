import datetime as dt

from pyspark.sql import functions as F

from kassa.operators import maintain as U
from kassa.sources.range_table import RangeTable

T = "transaction_id long, user_id long, date timestamp_ntz, description string, amount double, category string"


def table(spark):
    d = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, 10, d, "a", -1.0, "x"), (2, 10, d, "b", -2.0, "y")], T)


def test_update_keeps_description_and_rejects_unknown(spark):
    batch = spark.createDataFrame([(1, 1, None, 5.0, None), (2, 99, "z", 1.0, None)],
                                  "seq long, transaction_id long, description string, amount double, category string")
    new, rej = U.apply_updates(table(spark), batch)
    r = new.where("transaction_id = 1").first()
    assert (r.description, r.amount, r.category) == ("a", 5.0, "x")
    assert [x.transaction_id for x in rej.collect()] == [99]


def test_delete_and_reject(spark):
    new, rej = U.apply_deletes(table(spark), spark.createDataFrame([(2,), (7,)], "transaction_id long"))
    assert [r.transaction_id for r in new.collect()] == [1] and [r.transaction_id for r in rej.collect()] == [7]


def test_append_ids_default_date_and_fk(spark):
    users = spark.createDataFrame([(10, "u@x.org")], "id long, email string")
    batch = spark.createDataFrame([(5, 10, None, "n1", -3.0, "x"), (3, 10, dt.datetime(2024, 2, 1), "n0", 1.0, None),
                                   (4, 11, None, "bad", 1.0, None)],
                                  "seq long, user_id long, date timestamp_ntz, description string, amount double, category string")
    accepted, rej = U.split_by_owner(batch, users)
    new = U.append(table(spark), accepted)
    got = {r.description: (r.transaction_id, r.date is not None) for r in new.collect()}
    assert got["n0"] == (3, True) and got["n1"] == (4, True)
    assert [r.seq for r in rej.collect()] == [4]


def test_register_users_first_wins(spark):
    users = spark.createDataFrame([(1, "old@x.org")], "id long, email string")
    batch = spark.createDataFrame([(1, "new@x.org"), (2, "new@x.org"), (3, "old@x.org"), (4, "bad")],
                                  "seq long, email string")
    acceptable, rej = U.split_candidates(users, batch)
    acc = U.register_users(users, acceptable)
    assert [(r.id, r.email, r.seq) for r in acc.collect()] == [(2, "new@x.org", 1)]
    assert sorted((r.seq, r.reason) for r in rej.collect()) == [
        (2, "duplicate in batch"), (3, "already registered"), (4, "invalid email")]


def stored(spark, path, n=20_000, width=1000, **kw):
    rows = spark.range(n).select(
        F.col("id").alias("transaction_id"), (F.col("id") / 10).cast("long").alias("user_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("date"), F.concat(F.lit("d"), "id").alias("description"),
        F.col("id").cast("double").alias("amount"), F.lit("c").alias("category"))
    return RangeTable(spark, str(path), width=width, **kw).create(rows)


def rows_scanned(df):
    """Rows that left the file scan, before any filter (row groups that were not skipped)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, tmp_path):
    """At most a twentieth of the table for an id, at most a fifth for a user."""
    t = stored(spark, tmp_path / "t", 200_000, 50_000, row_group_bytes=64 << 10)
    assert [r.transaction_id for r in t.get(123_456).collect()] == [123_456] and t.get(10**9).count() == 0
    assert rows_scanned(t.get(123_456)) <= 10_000
    assert t.find("user_id", 777).count() == 10
    assert rows_scanned(t.find("user_id", 777)) <= 40_000


def test_batches_rewrite_their_ranges_only(spark, tmp_path):
    t = stored(spark, tmp_path / "t", 5000)
    before = {(r.id_range, r.file, r.modified) for r in t.files().collect()}
    rejected = t.update(spark.createDataFrame([(1, 1500, None, -1.0, "x"), (2, 10**6, "gone", 1.0, None)],
                                              "seq long, transaction_id long, description string, amount double, category string"))
    assert [r.transaction_id for r in rejected.collect()] == [10**6]
    r = t.get(1500).first()
    assert (r.description, r.amount, r.category) == ("d1500", -1.0, "x")
    gone = t.delete(spark.range(3000, 4001).select(F.col("id").alias("transaction_id")).unionByName(
        spark.createDataFrame([(-5,)], "transaction_id long")))
    assert [r.transaction_id for r in gone.collect()] == [-5]
    assert t.ranges() == [0, 1, 2, 4] and t.read().count() == 5000 - 1001  # range 3 is empty and removed
    after = {(r.id_range, r.file, r.modified) for r in t.files().collect()}
    assert {x for x in after if x in before} == {x for x in before if x[0] in (0, 2)}
    t.append(spark.createDataFrame([(2, 10, dt.datetime(2024, 2, 1), "second", 1.0, None), (1, 10, dt.datetime(2024, 2, 1), "first", 1.0, None)],
                                   "seq long, user_id long, date timestamp_ntz, description string, amount double, category string"))
    assert [(r.transaction_id, r.description) for r in t.read().where("transaction_id >= 5000").orderBy("transaction_id").collect()] == [
        (5000, "first"), (5001, "second")]
    assert t.ranges() == [0, 1, 2, 4, 5]


def test_empty_batches_change_nothing(spark, tmp_path):
    t = stored(spark, tmp_path / "t", 100)
    none = spark.createDataFrame([], "seq long, transaction_id long, description string, amount double, category string")
    assert t.update(none).count() == 0 and t.delete(none.select("transaction_id")).count() == 0 and t.read().count() == 100


def test_number_of_ranges_does_not_grow_with_the_table(spark):
    def width(n, step=1):
        return RangeTable.width_for(spark.range(0, n * step, step).select("id"), 2048)
    assert width(10) == 2048 and width(0) == 2048
    for n in (300_000, 3_000_000, 30_000_000):
        assert 2048 < width(n) and n / width(n) <= 128
    assert width(1000, 10**9) == 1 << 20
