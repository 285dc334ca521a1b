"""Table maintenance (U1-U5): the reference's REST calls re-aimed as batch jobs that
apply a change batch to a table and return (new table, rejects).  U2 and U5 come in two halves, so
asking for the rejects alone sorts and numbers nothing.

Per-id "latest change wins" uses ``max_by`` aggregates (map-side combined), not a
window per id, so an id with many changes is not one task; new ids come from
``dense_index`` (no global window).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.functions.text import is_valid_email
from kassa.operators.joins import new_emails
from kassa.operators.sequence import dense_index

TX_COLUMNS = ["transaction_id", "user_id", "date", "description", "amount", "category"]


def _max_id(table: DataFrame, col: str) -> int:
    """Largest id as one number (a single aggregate value, the id sequence's base)."""
    v = table.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def list_transactions(table: DataFrame, user_id: int | None = None) -> DataFrame:
    """U1/P5."""
    return table if user_id is None else table.filter(F.col("user_id") == F.lit(user_id))


def get_transaction(table: DataFrame, ident) -> DataFrame:
    """U1/P6."""
    return table.filter(F.col("transaction_id") == F.lit(ident))


def split_by_owner(batch: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U2, first half: (rows whose owner exists, rejected rows).  Missing date -> current time (UTC)."""
    b = batch.withColumn("date", F.coalesce(F.col("date"), F.localtimestamp()))
    ids = users.select(F.col("id").alias("user_id"))
    return b.join(ids, "user_id", "left_semi"), b.join(ids, "user_id", "left_anti")


def append(table: DataFrame, accepted: DataFrame) -> DataFrame:
    """U2, second half: accepted rows (seq, user_id, date, description, amount, category) get ids
    max(id) + 1, 2, ... in ``seq`` order."""
    return table.select(*TX_COLUMNS).unionByName(numbered_rows(table, accepted))


def numbered_rows(table: DataFrame, accepted: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The accepted rows alone, with the ids after ``table``'s largest."""
    top = _max_id(table, key)
    return dense_index(accepted, ["seq"], "_pos").withColumn(key, F.lit(top) + F.col("_pos")).select(*TX_COLUMNS)


def latest_per_id(batch: DataFrame, key: str = "transaction_id", seq: str = "seq",
                  optional: tuple = ("description", "category")) -> DataFrame:
    """Net effect of applying a batch in ``seq`` order: per field the last given value
    (a null in an optional field means "leave unchanged")."""
    cols = [c for c in batch.columns if c not in (key, seq)]
    aggs = []
    for c in cols:
        order = F.when(F.col(c).isNotNull(), F.col(seq)) if c in optional else F.col(seq)
        aggs.append(F.max_by(F.col(c), order).alias(f"new_{c}"))
    return batch.groupBy(key).agg(*aggs)


def apply_updates(table: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By id, changes applied in seq order: description and category only when
    given, amount always; user_id and date unchanged.  Unknown ids are rejected."""
    upd = latest_per_id(batch).withColumn("_hit", F.lit(True))
    joined = table.join(upd, "transaction_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    matched = upd.select("transaction_id").join(table.select("transaction_id"), "transaction_id", "left_semi")
    new = joined.select(
        "transaction_id", "user_id", "date",
        F.coalesce(F.col("new_description"), F.col("description")).alias("description"),
        F.when(hit, F.col("new_amount")).otherwise(F.col("amount")).alias("amount"),
        F.coalesce(F.col("new_category"), F.col("category")).alias("category"))
    rejected = upd.join(matched, "transaction_id", "left_anti").select("transaction_id")
    return new, rejected


def apply_deletes(table: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4: remove ids in the batch; ids not in the table are rejected."""
    ids = batch.select("transaction_id").distinct()
    return (table.join(ids, "transaction_id", "left_anti"),
            ids.join(table.select("transaction_id"), "transaction_id", "left_anti"))


def split_candidates(users: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U5, first half: batch (seq, email) -> (acceptable rows, rejected rows with a reason).

    Valid e-mail, not registered (J5), first in batch wins."""
    first = (batch.groupBy("email").agg(F.min("seq").alias("seq")))
    dup = batch.join(first, ["email", "seq"], "left_anti").withColumn("reason", F.lit("duplicate in batch"))
    cand = batch.join(first, ["email", "seq"], "left_semi")
    invalid = cand.filter(~is_valid_email(F.col("email"))).withColumn("reason", F.lit("invalid email"))
    valid = cand.filter(is_valid_email(F.col("email")))
    taken = valid.join(users.select("email"), "email", "left_semi").withColumn("reason", F.lit("already registered"))
    return new_emails(valid, users), dup.unionByName(invalid).unionByName(taken).select("seq", "email", "reason")


def register_users(users: DataFrame, acceptable: DataFrame) -> DataFrame:
    """U5, second half: acceptable rows with new ids in ``seq`` order."""
    top = _max_id(users, "id")
    return dense_index(acceptable, ["seq"], "_pos").select((F.lit(top) + F.col("_pos")).alias("id"), "email", "seq")
