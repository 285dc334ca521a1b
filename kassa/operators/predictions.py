"""Consumers of class probabilities.

Inputs carry ``prob_<class>`` columns (or an MLlib probability vector turned into
them by kassa.operators.classify); everything here is a column expression or one
aggregate, so it works the same on a fixture, on model output, or on a stream.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.operators.anomaly import exact_quantile
from kassa.session import materialise


def prob_columns(df: DataFrame, prefix: str = "prob_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def review_flag(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """needs_review = confidence < threshold (threshold 0 -> all false)."""
    return df.withColumn("needs_review", F.coalesce(F.col("confidence") < F.lit(float(threshold)), F.lit(False)))


def confidence_from_probs(df: DataFrame, prefix: str = "prob_") -> DataFrame:
    """confidence = max class probability."""
    return df.withColumn("confidence", F.greatest(*[F.col(f"`{c}`") for c in prob_columns(df, prefix)]))


def _ranked(df: DataFrame, prefix: str):
    """Array of (prob, category) sorted by prob desc, then category asc."""
    cols = prob_columns(df, prefix)
    arr = F.array(*[F.struct(F.col(f"`{c}`").alias("p"), F.lit(c[len(prefix):]).alias("c")) for c in cols])
    return F.array_sort(arr, lambda a, b: F.when(a.p > b.p, -1).when(a.p < b.p, 1)
                        .when(a.c < b.c, -1).when(a.c > b.c, 1).otherwise(0))


def top_k(df: DataFrame, k: int = 3, prefix: str = "prob_") -> DataFrame:
    """T4: top_{i}_category / top_{i}_prob, i = 1..k (no explode, no shuffle)."""
    r = _ranked(df, prefix)
    cols = {}
    for i in range(1, k + 1):
        cols[f"top_{i}_category"] = F.try_element_at(r, F.lit(i)).getField("c")
        cols[f"top_{i}_prob"] = F.try_element_at(r, F.lit(i)).getField("p")
    return df.withColumns(cols)


def ranked_probabilities(df: DataFrame, prefix: str = "prob_") -> DataFrame:
    """T5: all (category, probability) pairs sorted by probability desc."""
    r = _ranked(df, prefix)
    return df.withColumn("ranked_probabilities",
                         F.transform(r, lambda s: F.struct(s.c.alias("category"), s.p.alias("probability"))))


def accuracy(df: DataFrame, label: str = "category", pred: str = "predicted_category") -> DataFrame:
    """M5."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, label: str = "category", pred: str = "predicted_category") -> DataFrame:
    """(actual, predicted, n): the one aggregate that M6 and M7 are made of, written once."""
    counts = df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts, "confusion")


def confusion_long(df: DataFrame, label: str = "category", pred: str = "predicted_category",
                   max_classes: int = 1000) -> DataFrame:
    """M7 long form, zero-filled over all pairs of label and prediction classes.

    The pairs are asked for, so their number is the square of the classes'; more than
    ``max_classes`` are refused instead of being multiplied.
    """
    counts = confusion_counts(df, label, pred)
    names = counts.select(F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("c")).distinct()
    found = [r["c"] for r in names.limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    listed = F.array(*[F.lit(c) for c in found]) if found else F.array().cast("array<string>")
    pairs = names.select(F.col("c").alias("actual"), F.explode(listed).alias("predicted"))
    return pairs.join(counts.select(F.col("actual").alias("a"), F.col("predicted").alias("p"), "n"),
                      F.col("actual").eqNullSafe(F.col("a")) & F.col("predicted").eqNullSafe(F.col("p")), "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label: str = "category", pred: str = "predicted_category") -> DataFrame:
    """M6: per class precision, recall, f1, support + macro avg + weighted avg.

    Zero division gives 0 (sklearn's default warning value).  Everything is derived from the
    confusion counts, one row per pair of classes that occurs.
    """
    counts = confusion_counts(df, label, pred)
    # a count adds to its actual class's support, its predicted class's predictions, and to both when they agree
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    per = per.withColumns({"precision": share(F.col("tp"), F.col("predicted")), "recall": share(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    per = materialise(per.select("class", "precision", "recall", "f1", F.col("support").cast("long")), "per_class")
    tot = F.sum("support")
    scores = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], tot.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       *[(F.sum(F.col(c) * F.col("support")) / tot).alias(c) for c in scores], tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def predicted_breakdown(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """Count, total, mean amount, mean confidence (rounded 2), by count desc."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("amount"), 2).alias("total_amount"),
                                F.round(F.avg("amount"), 2).alias("avg_amount"),
                                F.round(F.avg("confidence"), 2).alias("avg_confidence"))
            .orderBy(F.desc("count"), col))


def distribution(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """Value counts, desc."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def confidence_stats(df: DataFrame) -> DataFrame:
    """Mean, exact median, min, max.  The median is found by histogram refinement."""
    c = F.col("confidence")
    return df.agg(F.avg(c).alias("mean_confidence"),
                  F.lit(exact_quantile(df, "confidence", 0.5)).cast("double").alias("median_confidence"),
                  F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def review_summary(df: DataFrame) -> DataFrame:
    """Total, review count, percent, average confidence."""
    n = F.count(F.lit(1))
    r = F.count_if(F.col("needs_review"))
    return df.agg(n.alias("total"), r.alias("needs_review"),
                  (100.0 * r / n).alias("review_pct"), F.avg("confidence").alias("avg_confidence"))


def distinct_categories(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """Distinct count (exact)."""
    return df.agg(F.count_distinct(col).alias("n_categories"))


def category_list(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """Distinct non-null values as strings."""
    return df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()


def confidence_histogram(df: DataFrame, bins: int = 30, marker: float = 0.5) -> DataFrame:
    """Fixed [0, 1] bins, value 1.0 in the last bin, empty bins kept, + marker bin flag."""
    b = F.least(F.floor(F.col("confidence") * bins).cast("long") + 1, F.lit(bins))
    counts = df.where(F.col("confidence").isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    mb = min(int(marker * bins) + 1, bins)
    return (all_bins.join(counts, "bin", "left").fillna(0, subset=["count"])
            .withColumns({"bin_start": (F.col("bin") - 1) / bins, "bin_end": F.col("bin") / bins,
                          "has_marker": F.col("bin") == mb}))


def monthly_category_totals(df: DataFrame, col: str = "predicted_category") -> DataFrame:
    """sum(amount) by month and category."""
    return (df.groupBy(F.date_format("date", "yyyy-MM").alias("month"), F.col(col).alias("category"))
            .agg(F.sum("amount").alias("amount")))
