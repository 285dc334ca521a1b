"""Streaming ledger jobs: file source -> stateless operators -> sink."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.functions import amount_columns, calendar_columns, spend, word_count
from kassa.operators.clean import coerce, drop_invalid, normalize_column_names, require_columns

RAW_LEDGER_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("category", T.StringType()),
])


def read_ledger_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_LEDGER_SCHEMA,
                       fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
            .option("header", True).load(path))


def stream_row_features(raw: DataFrame) -> DataFrame:
    """C1-C6 (no dedupe: that would be state) + F1-F8: all stateless, streaming-safe."""
    df = drop_invalid(coerce(require_columns(normalize_column_names(raw))))
    d, a = F.col("date"), F.col("amount")
    cols = {**calendar_columns(d), **amount_columns(a), "description_length": F.length("description"),
            "description_word_count": word_count(F.col("description")), "spend": spend(a)}
    return df.withColumns(cols)


def categorize_stream(raw: DataFrame, model=None, threshold: float = 0.5) -> DataFrame:
    """Row features, then (optionally) the category model: PipelineModel.transform is a
    map, so a trained model scores a stream as it scores a table.  Windowed features
    (rolling, monthly) are batch-only and are filled with 0 by the alignment step."""
    feat = stream_row_features(raw)
    if model is None:
        return feat
    from kassa.operators.classify import predict
    return predict(model, feat, threshold=threshold, prob_columns=False)


def daily_spend_stream(raw: DataFrame, watermark: str = "2 days") -> DataFrame:
    """G7 incrementally: tumbling 1-day windows of expense sums; late rows within the
    watermark update their day, older ones are dropped by the watermark."""
    # event time must be a (session-zone, UTC) TIMESTAMP for the watermark
    feat = stream_row_features(raw).withColumn("_event", F.col("date").cast("timestamp"))
    return (feat.withWatermark("_event", watermark)
            .groupBy(F.window("_event", "1 day").alias("w"))
            .agg(F.sum("spend").alias("y"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("ds"), "y", "n"))


def start(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
          trigger_once: bool = False):
    """Start a query with its checkpoint in a shared folder (restartable after failures)."""
    w = df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    if fmt not in ("memory", "console"):
        w = w.option("path", sink_path)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
