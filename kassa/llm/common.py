"""Helpers shared by the operators: the shared folder, tables that cut lineage, global order.

Operators never rely on a column's name being free: they select what they need under
their own names first, or carry the caller's row along as one struct column.
"""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words; a word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kassa-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one operator run, written under the shared folder.

    ``settle`` writes a frame and reads it back, which cuts its lineage: later steps
    survive lost executors without recomputing it, and values that depend on a task's
    number (row ids, partition ids) stay what they were.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def settle(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kassa_path = path
        return out

    def release(self) -> None:
        """Let go of finished steps' shuffle files: they go once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete settled tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._kassa_path)
            path.getFileSystem(conf).delete(path, True)


def give_back_memory() -> None:
    """In a task: returns freed memory to the system, so that a worker that waits for its next task is small."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def slices(batches, rows: int = 500):
    """Arrow batches in pieces of at most ``rows`` rows, so that what is made of one piece stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text):
    """Words of a string column as an array (null and blank texts: empty array)."""
    blanks = "".join(SPACES)
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(blanks))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def global_order(scratch: Scratch, df: DataFrame, order: list, tag: str) -> DataFrame:
    """``df`` with ``_part`` and ``_uid``, where (_part, _uid) follows ``order`` over all rows.

    A range sort written to a table: any key, however frequent, spreads over partitions as
    long as ``order`` ends with something that tells its rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.settle(
        ranged.withColumns({"_part": F.spark_partition_id(), "_uid": F.monotonically_increasing_id()}), tag)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Adds a row's place, from 0, in the order of a ``global_order`` table."""
    # one row per range partition, so this window holds as many rows as there are partitions
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_uid"))
    out = ordered.join(parts, ordered["_part"] == parts["_p"])
    return out.withColumn(name, F.col("_first") + inside - 1).drop("_p", "_first")


def with_next(ordered: DataFrame, columns: list[str], offset: int = 1) -> DataFrame:
    """Adds ``_next`` (struct of ``columns``) of the following row of a ``global_order`` table.

    ``offset=-1`` gives the row before.  Windows run inside one partition of the range sort;
    the rows at partition borders take theirs from a table with one row per partition.
    """
    value = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy("_part").orderBy("_uid")
    near = F.lead(value).over(inside) if offset > 0 else F.lag(value).over(inside)
    pick = F.min_by if offset > 0 else F.max_by
    border = ordered.groupBy("_part").agg(pick(value, F.col("_uid")).alias("_edge"))
    # one row per range partition, so this window holds as many rows as there are partitions
    across = Window.orderBy("_part")
    beyond = (F.lead("_edge") if offset > 0 else F.lag("_edge")).over(across)
    border = border.select(F.col("_part").alias("_p"), beyond.alias("_beyond"))
    out = ordered.withColumn("_near", near)
    out = out.join(border, out["_part"] == border["_p"], "left")
    return out.withColumn("_next", F.coalesce("_near", "_beyond")).drop("_near", "_beyond", "_p")
