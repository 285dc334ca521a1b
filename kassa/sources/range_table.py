"""A table laid out by ranges of its id, for point lookups and for committing change batches.

The table is a folder of Parquet partitions ``id_range = floor(id / width)``, sorted by id inside, in small row groups
with Bloom filters on the columns that rows are looked up by.  A range never holds more than ``width`` rows.

* A lookup by id reads one partition, and of that the row group whose minimum and maximum enclose the id.
  A lookup by another column skips every row group whose Bloom filter does not know the value.
* A batch of appends, updates or deletes reads and rewrites only the ranges it has ids in, with Spark's dynamic
  partition overwrite; files of other ranges stay as they are.  The new content is written under the shared
  scratch folder first, so a task that runs again never reads what is being replaced.  A range left
  without rows is removed (an overwrite with no rows leaves a partition alone).

One writer at a time.  Readers that started before a commit may have to start again, as with any
overwritten Parquet folder.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.operators import maintain as U
from kassa.session import materialise

RANGE = "id_range"


class RangeTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "transaction_id", width: int = 1 << 20,
                 lookup_columns: tuple[str, ...] = ("user_id",), row_group_bytes: int = 8 << 20):
        self.spark, self.path, self.key, self.width = spark, path.rstrip("/"), key, width
        self.options = {"parquet.block.size": str(row_group_bytes)}
        for c in lookup_columns:
            self.options |= {f"parquet.bloom.filter.enabled#{c}": "true",
                             f"parquet.bloom.filter.expected.ndv#{c}": str(min(width, 100_000))}

    # -- layout -----------------------------------------------------------------------
    @staticmethod
    def width_for(ids: DataFrame, least: int, ranges: int = 128, most: int = 1 << 20) -> int:
        """A width for a table with these ids (one column): about ``ranges`` partitions, so that their number does
        not grow with the table until they hold ``most`` ids each, but no width below ``least``."""
        c = F.col(ids.columns[0])
        low, high = ids.agg(F.min(c), F.max(c)).first()
        return least if low is None else max(least, min(most, -(-(high - low + 1) // ranges)))

    def _range(self, c) -> F.Column:
        return F.floor(c / F.lit(self.width)).cast("long")

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(RANGE, self._range(F.col(self.key))).repartition(RANGE).sortWithinPartitions(RANGE, self.key)

    def _writer(self, rows: DataFrame):
        return self._laid_out(rows).write.mode("overwrite").options(**self.options).partitionBy(RANGE)

    def _folder(self, i: int) -> str:
        return f"{self.path}/{RANGE}={i}"

    def ranges(self) -> list[int]:
        """Ranges that have a partition (one listing of the table's folder)."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
        return sorted(int(n[len(RANGE) + 1:]) for n in names if re.fullmatch(rf"{RANGE}=-?\d+", n))

    def _remove(self, i: int) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._folder(i))
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def create(self, rows: DataFrame) -> RangeTable:
        self._writer(rows).parquet(self.path)
        return self

    # -- reading ----------------------------------------------------------------------
    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(RANGE)

    def get(self, ident: int) -> DataFrame:
        """Zero or one row, from one partition."""
        return self.spark.read.parquet(self.path).where(
            (F.col(RANGE) == ident // self.width) & (F.col(self.key) == ident)).drop(RANGE)

    def find(self, column: str, value) -> DataFrame:
        """P5: the rows with ``value``, from the row groups that may hold it."""
        return self.read().where(F.col(column) == F.lit(value))

    def files(self) -> DataFrame:
        """(id_range, file, modified): every data file, from its rows' metadata."""
        return self.spark.read.parquet(self.path).select(
            RANGE, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).distinct()

    # -- change batches ---------------------------------------------------------------
    def _touched(self, ids: DataFrame) -> list[int]:
        """Ranges that a batch has ids in (one number per range)."""
        return [r[0] for r in ids.select(self._range(F.col(ids.columns[0])).alias("r")).distinct().collect() if r[0] is not None]

    def _content(self, touched: list[int], schema) -> DataFrame:
        """The rows of the touched ranges, and nothing else read."""
        there = set(self.ranges()).intersection(touched)
        if not there:
            return self.spark.createDataFrame([], schema)
        paths = [self._folder(i) for i in sorted(there)]
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop(RANGE)

    def _commit(self, touched: list[int], content: DataFrame) -> None:
        new = materialise(content, "commit")
        kept = {r[0] for r in new.select(self._range(F.col(self.key)).alias("r")).distinct().collect()}
        self._writer(new).option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for i in set(self.ranges()).intersection(touched) - kept:
            self._remove(i)

    def append(self, accepted: DataFrame) -> None:
        """Rows in ``seq`` order get the next ids; only the ranges of the new ids are written."""
        rows = materialise(U.numbered_rows(self.read(), accepted, self.key), "append")
        touched = self._touched(rows.select(self.key))
        self._commit(touched, self._content(touched, rows.schema).unionByName(rows))

    def update(self, batch: DataFrame) -> DataFrame:
        """U3; returns the rejected ids."""
        touched = self._touched(batch.select(self.key))
        new, rejected = U.apply_updates(self._content(touched, self.read().schema), batch)
        rejected = materialise(rejected, "rejected_updates")
        self._commit(touched, new)
        return rejected

    def delete(self, batch: DataFrame) -> DataFrame:
        """U4; returns the rejected ids."""
        touched = self._touched(batch.select(self.key))
        new, rejected = U.apply_deletes(self._content(touched, self.read().schema), batch)
        rejected = materialise(rejected, "rejected_deletes")
        self._commit(touched, new)
        return rejected

    def add(self, rows: DataFrame) -> None:
        """Rows that already have ids (U5's new users)."""
        rows = materialise(rows, "add")
        touched = self._touched(rows.select(self.key))
        self._commit(touched, self._content(touched, rows.schema).unionByName(rows))
