"""Table maintenance (U1-U5, J5) with change batches derived from the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from kassa.operators import maintain as U
from kassa.plans.common import LEDGER_SPEC
from kassa.plans.registry import register
from kassa.session import materialise, scratch_path
from kassa.sources.range_table import RangeTable


def append_batch(t):
    e = t.raw("events")
    return e.select(F.col("event_id").alias("seq"), "user_id", F.col("ts").alias("date"),
                    F.col("event_type").alias("description"), (-F.col("value")).alias("amount"),
                    F.col("event_type").alias("category"))


APPEND_BATCH_SQL = ("SELECT event_id AS seq, user_id, ts AS date, event_type AS description, -value AS amount, "
                    "event_type AS category FROM events")


@register("U2_append_transactions", LEDGER_SPEC, f"""
WITH b AS ({APPEND_BATCH_SQL}),
ok AS (SELECT * FROM b WHERE user_id IN (SELECT id FROM users))
SELECT * FROM ledger UNION ALL
SELECT (SELECT max(transaction_id) FROM ledger) + row_number() OVER (ORDER BY seq) AS transaction_id,
       user_id, date, description, amount, category FROM ok""")
def q_u2(t):
    accepted, _ = U.split_by_owner(append_batch(t), t.users())
    return U.append(t.ledger(), accepted)


@register("U2_rejected_appends", "seq long, user_id long",
          f"SELECT seq, user_id FROM ({APPEND_BATCH_SQL}) b WHERE user_id NOT IN (SELECT id FROM users)")
def q_u2r(t):
    return U.split_by_owner(append_batch(t), t.users())[1]


def update_batch(t):
    o = t.raw("orders").where(F.col("o_orderkey") % 5 == 0)
    a = o.select((F.col("o_orderkey") * 2).alias("seq"), F.col("o_orderkey").alias("transaction_id"),
                 F.concat(F.lit("updated "), F.col("o_orderpriority")).alias("description"),
                 (F.col("o_totalprice") / 2000).alias("amount"), F.lit(None).cast("string").alias("category"))
    b = o.where(F.col("o_orderkey") % 3 == 0).select(
        (F.col("o_orderkey") * 2 + 1).alias("seq"), F.col("o_orderkey").alias("transaction_id"),
        F.lit(None).cast("string").alias("description"), (-F.col("o_totalprice") / 3000).alias("amount"),
        F.lit("Corrected").alias("category"))
    c = o.where(F.col("o_orderkey") % 11 == 0).select(
        (F.col("o_orderkey") * 2).alias("seq"), (F.col("o_orderkey") + 100_000_000).alias("transaction_id"),
        F.lit("ghost").alias("description"), F.lit(1.0).alias("amount"), F.lit(None).cast("string").alias("category"))
    return a.unionByName(b).unionByName(c)


UPDATE_BATCH_SQL = """
SELECT o_orderkey * 2 AS seq, o_orderkey AS transaction_id, 'updated ' || o_orderpriority AS description,
       o_totalprice / 2000 AS amount, CAST(NULL AS VARCHAR) AS category FROM orders WHERE o_orderkey % 5 = 0
UNION ALL
SELECT o_orderkey * 2 + 1, o_orderkey, NULL, -o_totalprice / 3000, 'Corrected' FROM orders
WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 0
UNION ALL
SELECT o_orderkey * 2, o_orderkey + 100000000, 'ghost', 1.0, NULL FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 11 = 0"""


@register("U3_apply_updates", LEDGER_SPEC, f"""
WITH b AS ({UPDATE_BATCH_SQL}),
u AS (SELECT transaction_id, arg_max(description, seq) AS nd, arg_max(amount, seq) AS na, arg_max(category, seq) AS nc
      FROM b GROUP BY 1)
SELECT l.transaction_id, user_id, date, coalesce(nd, description) AS description,
       CASE WHEN u.transaction_id IS NOT NULL THEN na ELSE amount END AS amount, coalesce(nc, category) AS category
FROM ledger l LEFT JOIN u ON l.transaction_id = u.transaction_id""")
def q_u3(t):
    new, _ = U.apply_updates(t.ledger(), update_batch(t))
    return new


@register("U3_rejected_updates", "transaction_id long", f"""
SELECT DISTINCT transaction_id FROM ({UPDATE_BATCH_SQL}) b WHERE transaction_id NOT IN (SELECT transaction_id FROM ledger)""")
def q_u3r(t):
    _, rej = U.apply_updates(t.ledger(), update_batch(t))
    return rej


def delete_batch(t):
    o = t.raw("orders").where(F.col("o_orderkey") % 4 == 0)
    return o.select(F.col("o_orderkey").alias("transaction_id")).unionByName(
        o.where(F.col("o_orderkey") % 9 == 0).select((F.col("o_orderkey") + 100_000_000).alias("transaction_id")))


DELETE_SQL = ("SELECT o_orderkey AS transaction_id FROM orders WHERE o_orderkey % 4 = 0 UNION ALL "
              "SELECT o_orderkey + 100000000 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 9 = 0")


@register("U4_apply_deletes", LEDGER_SPEC,
          f"SELECT * FROM ledger WHERE transaction_id NOT IN ({DELETE_SQL})")
def q_u4(t):
    new, _ = U.apply_deletes(t.ledger(), delete_batch(t))
    return new


@register("U4_rejected_deletes", "transaction_id long",
          f"SELECT DISTINCT transaction_id FROM ({DELETE_SQL}) d WHERE transaction_id NOT IN (SELECT transaction_id FROM ledger)")
def q_u4r(t):
    _, rej = U.apply_deletes(t.ledger(), delete_batch(t))
    return rej


def user_batch(t):
    s, c = t.raw("supplier"), t.raw("customer")
    new = s.select(F.col("s_suppkey").alias("seq"),
                   F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name"))
                    .otherwise(F.concat(F.col("s_name"), F.lit("@example.com"))).alias("email"))
    again = s.where(F.col("s_suppkey") % 5 == 0).select((F.col("s_suppkey") + 1_000_000).alias("seq"),
                                                        F.concat(F.col("s_name"), F.lit("@example.com")).alias("email"))
    old = c.where(F.col("c_custkey") % 10 == 0).select((F.col("c_custkey") + 2_000_000).alias("seq"),
                                                        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"))
    return new.unionByName(again).unionByName(old)


USER_BATCH_SQL = """
SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE s_name || '@example.com' END AS email FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_name || '@example.com' FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT c_custkey + 2000000, c_name || '@example.com' FROM customer WHERE c_custkey % 10 = 0"""
VALID = "coalesce(regexp_full_match(email, '^[A-Za-z0-9._%+#-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}$'), false)"


@register("U5_register_users", "id long, email string, seq long", f"""
WITH b AS ({USER_BATCH_SQL}),
f AS (SELECT email, min(seq) AS seq FROM b GROUP BY email),
ok AS (SELECT * FROM f WHERE {VALID} AND email NOT IN (SELECT email FROM users))
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id, email, seq FROM ok""")
def q_u5(t):
    acceptable, _ = U.split_candidates(t.users(), user_batch(t))
    return U.register_users(t.users(), acceptable)


@register("U5_J5_rejected_users", "seq long, email string, reason string", f"""
WITH b AS ({USER_BATCH_SQL}),
f AS (SELECT email, min(seq) AS seq FROM b GROUP BY email)
SELECT seq, email, 'duplicate in batch' AS reason FROM b WHERE (email, seq) NOT IN (SELECT (email, seq) FROM f)
UNION ALL SELECT seq, email, 'invalid email' FROM f WHERE NOT {VALID}
UNION ALL SELECT seq, email, 'already registered' FROM f WHERE {VALID} AND email IN (SELECT email FROM users)""")
def q_u5r(t):
    return U.split_candidates(t.users(), user_batch(t))[1]


@register("U1_list_user_transactions", LEDGER_SPEC, "SELECT * FROM ledger WHERE user_id = 1000")
def q_u1(t):
    return U.list_transactions(t.ledger(), 1000)


# ---- change batches committed to a table laid out by id ranges -------------------------
WIDTH = 2048
AFTER_APPEND = f"""
SELECT * FROM ledger UNION ALL
SELECT (SELECT max(transaction_id) FROM ledger) + row_number() OVER (ORDER BY seq) AS transaction_id,
       user_id, date, description, amount, category FROM ({APPEND_BATCH_SQL}) b WHERE user_id IN (SELECT id FROM users)"""
# changes of the upper half of the ids only
LATE = "o_orderkey * 2 > (SELECT max(o_orderkey) FROM orders)"
LATE_UPDATES = f"SELECT * FROM ({UPDATE_BATCH_SQL}) b WHERE transaction_id IN (SELECT o_orderkey FROM orders WHERE {LATE})"
LATE_DELETES = f"SELECT o_orderkey AS transaction_id FROM orders WHERE o_orderkey % 4 = 0 AND {LATE}"
AFTER_ALL = f"""
WITH b AS ({LATE_UPDATES}),
u AS (SELECT transaction_id, arg_max(description, seq) AS nd, arg_max(amount, seq) AS na, arg_max(category, seq) AS nc
      FROM b GROUP BY 1),
a AS ({AFTER_APPEND})
SELECT a.transaction_id, user_id, date, coalesce(nd, description) AS description,
       CASE WHEN u.transaction_id IS NOT NULL THEN na ELSE amount END AS amount, coalesce(nc, category) AS category
FROM a LEFT JOIN u ON a.transaction_id = u.transaction_id
WHERE a.transaction_id NOT IN ({LATE_DELETES})"""


def stored(t, name, width=WIDTH):
    return RangeTable(t.spark, scratch_path(t.spark, name), width=width).create(t.ledger())


def late_changes(t):
    late = t.raw("orders").join(t.raw("orders").agg(F.max("o_orderkey").alias("_top")), F.col("o_orderkey") * 2 > F.col("_top"))
    ids = late.select(F.col("o_orderkey").alias("transaction_id"))
    updates = update_batch(t).join(ids, "transaction_id", "left_semi")
    return updates, ids.where(F.col("transaction_id") % 4 == 0)


def committed(t, name, width=WIDTH):
    table = stored(t, name, width)
    before = materialise(table.files(), "files")
    accepted, _ = U.split_by_owner(append_batch(t), t.users())
    table.append(accepted)
    updates, deletes = late_changes(t)
    table.update(updates)
    table.delete(deletes)
    return table, before


@register("U2_U4_committed_table", LEDGER_SPEC, AFTER_ALL)
def q_commit(t):
    """The stored table after an append, an update and a delete batch."""
    width = RangeTable.width_for(t.raw("orders").select("o_orderkey"), WIDTH)
    return committed(t, "committed", width)[0].read()


@register("U2_U4_untouched_files", "id_range long, n_rows long, unchanged boolean", f"""
WITH r AS (SELECT transaction_id, floor(transaction_id / {WIDTH})::BIGINT AS id_range FROM ({AFTER_ALL}) x),
touched AS (
  SELECT floor(transaction_id / {WIDTH})::BIGINT AS id_range FROM (
    SELECT transaction_id FROM ({LATE_UPDATES}) u UNION ALL SELECT * FROM ({LATE_DELETES}) d
    UNION ALL SELECT transaction_id FROM ({AFTER_APPEND}) a WHERE transaction_id > (SELECT max(transaction_id) FROM ledger)) z)
SELECT id_range, count(*) AS n_rows, id_range NOT IN (SELECT id_range FROM touched) AS unchanged FROM r GROUP BY id_range""")
def q_untouched(t):
    """Per range its rows, and whether the files from before the three batches are still the ones there."""
    table, before = committed(t, "untouched")
    old = before.withColumnsRenamed({"file": "old_file", "modified": "old_time"})
    now = table.files()
    same = now.join(old.drop("id_range"), (F.col("file") == F.col("old_file")) & (F.col("modified") == F.col("old_time")), "left")
    same = same.groupBy("id_range").agg(F.bool_and(F.col("old_file").isNotNull()).alias("unchanged"))
    counts = t.spark.read.parquet(table.path).groupBy("id_range").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(same, "id_range")


@register("U5_committed_users", "id long, email string", f"""
WITH b AS ({USER_BATCH_SQL}),
f AS (SELECT email, min(seq) AS seq FROM b GROUP BY email),
ok AS (SELECT * FROM f WHERE {VALID} AND email NOT IN (SELECT email FROM users))
SELECT id, email FROM users UNION ALL
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id, email FROM ok""")
def q_commit_users(t):
    users = t.users().select("id", "email")
    table = RangeTable(t.spark, scratch_path(t.spark, "users"), "id", WIDTH, ("email",)).create(users)
    acceptable, _ = U.split_candidates(table.read(), user_batch(t))
    table.add(U.register_users(table.read(), acceptable).select("id", "email"))
    return table.read()


@register("P6_U1_stored_lookup", LEDGER_SPEC, "SELECT * FROM ledger WHERE transaction_id = (SELECT min(transaction_id) FROM ledger WHERE user_id >= 50)")
def q_stored_lookup(t):
    ident = t.ledger().where("user_id >= 50").agg(F.min("transaction_id")).first()[0]
    return stored(t, "lookup").get(ident)


@register("P5_U1_stored_user", LEDGER_SPEC, "SELECT * FROM ledger WHERE user_id = 100")
def q_stored_user(t):
    return stored(t, "by_user").find("user_id", 100)
