"""Session helpers: one place for the settings every operator relies on."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. They are SQL confs, so they can be applied to an
# existing session (the driver's or a cluster's) without a restart.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_DEFAULTS to a running session (idempotent)."""
    for k, v in RUNTIME_DEFAULTS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def build_session(master: str | None = None, app: str = "kassa",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and call ensure_defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # no Python call-site capture per DataFrame call (it walks the stack and makes
         # a conf round trip each time; only error messages use it)
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.driver.memory", os.environ.get("KASSA_DRIVER_MEMORY", "8g")))
    for k, v in RUNTIME_DEFAULTS.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage, shared by driver and executors.

    The one the session already uses, else ``spark.checkpoint.dir``.  Only a local session
    without either gets a scratch folder of its own; a cluster without one is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="kassa-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new table location under the shared folder; no two calls get the same."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kassa/{uuid.uuid4().hex[:12]}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, it needs no executor's memory,
    and the planner knows its true size when it chooses a join."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
