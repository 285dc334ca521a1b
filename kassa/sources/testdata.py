"""Ledger-shaped views over the driver's test tables (FIXTURES.md section 2).

Every view is built twice from the same rule: as a Spark DataFrame (``Tables``) and
as DuckDB SQL (``ORACLE_VIEWS``) for the oracle check.  All views read whole tables.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.session import ensure_defaults

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()

# The five ledger categories (TPC-H order priorities), alphabetical order,
# used by the deterministic prediction fixture.
LEDGER_CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Classes of the learnable ledger (the reference's category names):
# Income, Food & Dining, Shopping, Bills & Utilities.

# The width of ``embeddings.embedding``; every value is a metric.
METRIC_FEATURES = 64


class Tables:
    """Lazily built DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_defaults(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    # -- main ledger ---------------------------------------------------------
    def ledger(self) -> DataFrame:
        o, c = self.raw("orders"), self.raw("customer")
        # No broadcast hint: customer grows with the data; AQE picks broadcast only
        # when the measured side is small.
        return (o.join(c, o.o_custkey == c.c_custkey)
                .select(o.o_orderkey.alias("transaction_id"),
                        o.o_custkey.alias("user_id"),
                        o.o_orderdate.alias("date"),
                        F.concat_ws(" ", c.c_mktsegment, o.o_orderpriority).alias("description"),
                        F.when(o.o_orderstatus == "P", o.o_totalprice / 1000)
                         .otherwise(-o.o_totalprice / 1000).alias("amount"),
                        o.o_orderpriority.alias("category")))

    def ledger_learnable(self) -> DataFrame:
        return self.ledger().withColumn("category", learnable_category(F.col("amount")))

    def ledger_intraday(self) -> DataFrame:
        e = self.raw("events")
        return e.select(e.event_id.alias("transaction_id"), e.user_id, e.ts.alias("date"),
                        e.event_type.alias("description"),
                        F.when(e.event_type == "signup", e.value).otherwise(-e.value).alias("amount"),
                        e.event_type.alias("category"))

    def ledger_dirty(self) -> DataFrame:
        """Raw-looking ledger: strings, odd header case, bad values, padding, duplicates."""
        l = self.ledger()
        tid = F.col("transaction_id")
        rows = l.select(
            F.col("transaction_id").cast("string").alias("Transaction_ID"),
            F.when(tid % 50 == 0, F.lit("not a date"))
             .when(tid % 7 == 0, F.date_format("date", "MM/dd/yyyy"))
             .otherwise(F.date_format("date", "yyyy-MM-dd")).alias(" Date "),
            F.when(tid % 3 == 0, F.concat(F.lit("  "), F.upper("description"), F.lit("\t")))
             .otherwise(F.col("description")).alias("Description"),
            F.when(tid % 50 == 1, F.lit("n/a")).when(tid % 50 == 2, F.lit("1d")).when(tid % 50 == 3, F.lit("5F"))
             .when(tid % 50 == 4, F.lit("0x1p3")).when(tid % 50 == 5, F.lit("inf"))
             .otherwise(F.col("amount").cast("string")).alias("AMOUNT"),
            F.col("category").alias("Category"),
            F.col("user_id").cast("string").alias("User_Id"))
        return rows.unionByName(rows.filter(tid % 20 == 0))

    def ledger_undated(self) -> DataFrame:
        """The ledger with every fortieth date missing."""
        return self.ledger().withColumn("date", F.when(F.col("transaction_id") % 40 != 0, F.col("date")))

    def predictions_fixed(self) -> DataFrame:
        return with_fixed_predictions(self.ledger())

    def metrics(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(e.vec_id.alias("row_id"),
                        *[e.embedding[i].cast("double").alias(f"feature_{i}")
                          for i in range(METRIC_FEATURES)],
                        e.label.cast("double").alias("target"))

    def users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(c.c_custkey.alias("id"),
                        F.concat(c.c_name, F.lit("@example.com")).alias("email"),
                        F.lit(None).cast("string").alias("hashed_password"))


def learnable_category(amount: Column) -> Column:
    """Category that is a function of the amount (classifier quality floors)."""
    return (F.when(amount > 0, "Income").when(F.abs(amount) < 50, "Food & Dining")
            .when(F.abs(amount) < 150, "Shopping").otherwise("Bills & Utilities"))


# ---- deterministic prediction fixture --------------------------------------------

def fixed_scores(tid: Column) -> list[Column]:
    """Integer class scores; the same rule is written in SQL in ``_fixed_scores_sql``."""
    k = len(LEDGER_CATEGORIES)
    return [((tid * 7 + c * 13) % 11) + 1 + F.when(tid % k == c, tid % 37).otherwise(0)
            for c in range(k)]


def _fixed_scores_sql(tid: str) -> list[str]:
    k = len(LEDGER_CATEGORIES)
    return [f"((({tid} * 7 + {c * 13}) % 11) + 1 + CASE WHEN {tid} % {k} = {c} THEN {tid} % 37 ELSE 0 END)"
            for c in range(k)]


def prob_col(category: str) -> str:
    return f"prob_{category}"


def with_fixed_predictions(ledger: DataFrame) -> DataFrame:
    s = fixed_scores(F.col("transaction_id"))
    total = reduce(lambda a, b: a + b, s)
    arr = F.array(*s)
    best = F.array_position(arr, F.array_max(arr))            # 1-based, first max wins
    cats = F.array(*[F.lit(c) for c in LEDGER_CATEGORIES])
    probs = {prob_col(c): (s[i] / total).cast("double") for i, c in enumerate(LEDGER_CATEGORIES)}
    return (ledger.withColumns(probs)
            .withColumn("predicted_category", F.element_at(cats, best.cast("int")))
            .withColumn("confidence", (F.array_max(arr) / total).cast("double")))


# ---- the same views in DuckDB SQL --------------------------------------------------

def _fixed_predictions_sql() -> str:
    s = _fixed_scores_sql("transaction_id")
    total = " + ".join(s)
    probs = ", ".join(f'CAST({x} AS DOUBLE) / ({total}) AS "{prob_col(c)}"'
                      for x, c in zip(s, LEDGER_CATEGORIES))
    arr = "[" + ", ".join(s) + "]"
    cats = "[" + ", ".join(f"'{c}'" for c in LEDGER_CATEGORIES) + "]"
    return (f"SELECT *, {probs}, {cats}[list_position({arr}, list_max({arr}))] AS predicted_category, "
            f"CAST(list_max({arr}) AS DOUBLE) / ({total}) AS confidence FROM ledger")


ORACLE_VIEWS = {
    "ledger": """
SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS date,
       c_mktsegment || ' ' || o_orderpriority AS description,
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 1000 ELSE -o_totalprice / 1000 END AS amount,
       o_orderpriority AS category
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ledger_learnable": """
SELECT transaction_id, user_id, date, description, amount,
       CASE WHEN amount > 0 THEN 'Income' WHEN abs(amount) < 50 THEN 'Food & Dining'
            WHEN abs(amount) < 150 THEN 'Shopping' ELSE 'Bills & Utilities' END AS category
FROM ledger""",
    "ledger_intraday": """
SELECT event_id AS transaction_id, user_id, ts AS date, event_type AS description,
       CASE WHEN event_type = 'signup' THEN value ELSE -value END AS amount, event_type AS category
FROM events""",
    "ledger_dirty": """
WITH r AS (
  SELECT transaction_id AS tid, CAST(transaction_id AS VARCHAR) AS "Transaction_ID",
         CASE WHEN transaction_id % 50 = 0 THEN 'not a date' WHEN transaction_id % 7 = 0 THEN strftime(date, '%m/%d/%Y')
              ELSE strftime(date, '%Y-%m-%d') END AS " Date ",
         CASE WHEN transaction_id % 3 = 0 THEN '  ' || upper(description) || chr(9) ELSE description END AS "Description",
         CASE transaction_id % 50 WHEN 1 THEN 'n/a' WHEN 2 THEN '1d' WHEN 3 THEN '5F' WHEN 4 THEN '0x1p3'
              WHEN 5 THEN 'inf' ELSE CAST(amount AS VARCHAR) END AS "AMOUNT",
         category AS "Category", CAST(user_id AS VARCHAR) AS "User_Id"
  FROM ledger)
SELECT * EXCLUDE (tid) FROM r UNION ALL SELECT * EXCLUDE (tid) FROM r WHERE tid % 20 = 0""",
    "ledger_undated": "SELECT * REPLACE (CASE WHEN transaction_id % 40 <> 0 THEN date END AS date) FROM ledger",
    "predictions_fixed": _fixed_predictions_sql(),
    "metrics": "SELECT vec_id AS row_id, " + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i}" for i in range(METRIC_FEATURES))
        + ", CAST(label AS DOUBLE) AS target FROM embeddings",
    "users": "SELECT c_custkey AS id, c_name || '@example.com' AS email, CAST(NULL AS VARCHAR) AS hashed_password FROM customer",
}


def with_views(sql: str, names: list[str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of the views it needs (all views by default)."""
    order = list(ORACLE_VIEWS)
    used = [n for n in order if names is None or n in names]
    ctes = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in used)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
