"""Anomaly scoring.

Model parameters are small and bounded by the number of features (d means and stds,
a d x d reconstruction map, or a few thousand network weights), so they live on the
driver as numbers and travel with the task: scoring is one Arrow-batched matrix
product (linear maps) or ``mapInPandas`` (the nonlinear autoencoder), no shuffle.  The 95th-percentile threshold is exact and
distributed (``exact_quantile``).
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.functions.amounts import anomaly_label


# ---- M14 feature alignment ----------------------------------------------------------
def align_for_scoring(df: DataFrame, expected: list[str], key: str = "row_id") -> DataFrame:
    """Expected names if all present; else the first len(expected) numeric columns
    (positional rule, SURVEY Q12); pad with zero columns when there are fewer."""
    n = len(expected)
    if all(c in df.columns for c in expected):
        return df.select(key, *expected)
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name != key][:n]
    cols = [F.col(f"`{c}`").cast("double").alias(expected[i]) for i, c in enumerate(numeric)]
    cols += [F.lit(0.0).alias(expected[i]) for i in range(len(numeric), n)]
    return df.select(key, *cols)


# ---- M13 scaler ----------------------------------------------------------------------
@dataclass
class Scaler:
    columns: list[str]
    mean: list[float]
    scale: list[float]        # population std, 0 -> 1

    def columns_scaled(self) -> dict[str, Column]:
        return {f"{c}_scaled": (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.mean, self.scale)}


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """One aggregate; population std (MLlib's StandardScaler uses sample std)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    means = [float(row[f"m{i}"]) for i in range(len(cols))]
    scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
    return Scaler(list(cols), means, scales)


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns(scaler.columns_scaled())


# ---- reconstruction models -----------------------------------------------------------
@dataclass
class LinearDecoder:
    """x_hat = x @ A + b on scaled features (PCA: A = W W^T, b = 0)."""
    matrix: list[list[float]]
    bias: list[float] = field(default_factory=list)

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        out = x @ np.array(self.matrix, float)
        return out + np.array(self.bias, float) if self.bias else out


def neighbour_decoder(d: int) -> LinearDecoder:
    """Fixed test decoder: each feature reconstructed as the mean of itself and the next one."""
    m = [[0.0] * d for _ in range(d)]
    for i in range(d):
        m[i][i] += 0.5
        m[(i + 1) % d][i] += 0.5
    return LinearDecoder(m)


def fit_pca_decoder(df: DataFrame, scaled_cols: list[str], k: int | None = None) -> LinearDecoder:
    """The optimal linear autoencoder of width k (principal subspace) via MLlib PCA."""
    from pyspark.ml.feature import PCA, VectorAssembler
    d = len(scaled_cols)
    k = k or max(3, d // 3)
    vec = VectorAssembler(inputCols=scaled_cols, outputCol="_v").transform(df.select(*scaled_cols))
    pc = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec).pc.toArray()   # d x k
    return LinearDecoder((pc @ pc.T).tolist())


_SCORED = T.StructType([T.StructField("recon", T.ArrayType(T.DoubleType())), T.StructField("error", T.DoubleType())])


def mean_squared(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    return ((x - out) ** 2).mean(axis=1)


def score_linear(df: DataFrame, scaler: Scaler, decoder: LinearDecoder) -> DataFrame:
    """M16 for linear decoders: scaled_i, recon_i, reconstruction_error (mean squared diff).

    The map is one matrix product per Arrow batch; written out as columns, a wide matrix's
    expressions outgrow what generated code can hold.  A missing feature makes the error null.
    """
    @F.pandas_udf(_SCORED)
    def run(rows: pd.Series) -> pd.DataFrame:
        x = np.array(rows.tolist(), dtype=float).reshape(len(rows), len(scaler.columns))
        out = decoder.reconstruct(x)
        error = pd.Series(mean_squared(x, out))
        return pd.DataFrame({"recon": list(out), "error": error.astype(object).where(error.notna(), None)})

    scaled = scaler.columns_scaled()
    s = df.withColumn("_z", F.array(*scaled.values())).withColumn("_s", run("_z"))
    cols = {name: F.get("_z", F.lit(i)) for i, name in enumerate(scaled)}
    cols |= {f"{c}_recon": F.get("_s.recon", F.lit(i)) for i, c in enumerate(scaler.columns)}
    return s.withColumns(cols | {"reconstruction_error": F.col("_s.error")}).drop("_z", "_s")


# ---- G19 exact quantile --------------------------------------------------------------
# Size of the KLL sketch and the share of ranks taken on either side: 2.5 times the error that
# 99 of 100 sketches of that size keep; and at how many even ranks the sketch is read.  Only the
# number of passes depends on them.
SKETCH, SLACK, GRID = 8192, 0.0017, 2048


def exact_quantile(df: DataFrame, col: str, p: float, buckets: int = 1 << 17) -> float | None:
    """Exact linear-interpolation quantile (numpy default) without gathering the column.

    A pass is one aggregate: it counts the values below, at the ends of and inside a bracket, and sketches
    (KLL) the inside.  The sketch gives the next bracket around the wanted rank, a few thousandths of the
    inside.  Once at most ``buckets`` values are inside, their counts by value give the answer.  So
    10^10 rows take three jobs, and every further factor of 300 one more; repeated values cost nothing, as the
    ends are counted apart, and a sketch that misses only costs a pass.  The next order statistic is that
    value again or the least one above it.  Infinities are values like others.
    """
    # The passes read one double column several times; persisting it (bounded: one column, released
    # below) keeps each pass from recomputing the plan above and a large scoring expression from
    # being inlined into every aggregate.  Lost blocks are recomputed from the lineage.
    base = (df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return _exact_quantile(base, p, buckets)
    finally:
        base.unpersist()


def _exact_quantile(base: DataFrame, p: float, buckets: int) -> float | None:
    x, inf = F.col("_x"), float("inf")
    lo, hi, rank, n = -inf, inf, None, None
    while True:
        inside = (x > lo) & (x < hi)
        counts = base.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("at_lo"),
            F.count_if(inside).alias("mid"), F.count_if(x == hi).alias("at_hi"),
            F.min(F.when(x > lo, x)).alias("after_lo"), F.min(F.when(x > hi, x)).alias("after_hi"),
            F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH)).alias("sketch"))
        # as text, in one call; the function takes constants only
        grid = F.expr(f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})")
        values = F.when(F.col("mid") > 0, F.kll_sketch_get_quantile_double("sketch", grid))
        st = counts.select("*", values.alias("grid")).drop("sketch").first()
        if rank is None:
            n = st["n"]
            if not n:
                return None
            h = (n - 1) * p
            rank = int(math.floor(h))
        up_to_lo = st["below"] + st["at_lo"]
        up_to_mid = up_to_lo + st["mid"]
        up_to_hi = up_to_mid + st["at_hi"]
        if rank < st["below"]:       # a sketch that missed: the rank is outside
            lo, hi = -inf, lo
        elif rank >= up_to_hi:
            lo, hi = hi, inf
        elif rank < up_to_lo:
            v0, v1 = lo, lo if rank + 1 < up_to_lo else st["after_lo"]
            break
        elif rank >= up_to_mid:
            v0, v1 = hi, hi if rank + 1 < up_to_hi else st["after_hi"]
            break
        elif st["mid"] <= buckets:
            v0, v1 = _among(base.where(inside), rank - up_to_lo, hi)
            break
        else:
            at = (rank - up_to_lo) / st["mid"]
            lo = st["grid"][max(0, math.floor((at - SLACK) * GRID))]
            hi = st["grid"][min(GRID, math.ceil((at + SLACK) * GRID) + 1)]
    if h == rank or v0 == v1:
        return float(v0)
    return float(v0 + (h - rank) * (v1 - v0))


def _among(few: DataFrame, rank: int, beyond: float) -> tuple[float, float]:
    """The values of ``rank`` (from 0) and the next one, where there are few rows; ``beyond`` follows them all."""
    seen, v0 = 0, None
    for v, c in sorted((r[0], r[1]) for r in few.groupBy("_x").agg(F.count(F.lit(1))).collect()):
        seen += c
        if v0 is not None:
            return v0, v
        if seen > rank + 1:
            return v, v
        if seen > rank:
            v0 = v
    return v0, beyond


# ---- M17, G22, T1, M18 -----------------------------------------------------------------
def flag(df: DataFrame, threshold: float, col: str = "reconstruction_error") -> DataFrame:
    """Strictly greater than the threshold; F16 label."""
    f = F.col(col) > F.lit(float(threshold))
    return df.withColumns({"is_anomaly": f, "anomaly_label": anomaly_label(f),
                           "threshold": F.lit(float(threshold))})


def detect(df: DataFrame, scaler: Scaler, decoder: LinearDecoder, threshold: float | None = None,
           percentile: float = 95.0) -> DataFrame:
    """M14-M17 with a linear decoder: scaled, reconstructed, error, threshold, flag."""
    scored = score_linear(df, scaler, decoder)
    if threshold is None:
        threshold = exact_quantile(scored, "reconstruction_error", percentile / 100.0)
    return flag(scored, threshold)


def top_anomalies(scored: DataFrame, n: int = 10, key: str = "row_id") -> DataFrame:
    """Largest errors among flagged rows (TakeOrderedAndProject)."""
    return scored.filter(F.col("is_anomaly")).orderBy(F.desc("reconstruction_error"), key).limit(n)


def contributions(scored: DataFrame, cols: list[str], key: str = "row_id") -> DataFrame:
    """Per row and feature: original, scaled, reconstructed, squared error, percent
    of the row's total (sums to 100 per row).  Works for every row given, not one index."""
    # The output columns feature, original_value, scaled_value,
    # reconstructed_scaled, squared_error and contribution_pct.
    sq = {c: F.pow(F.col(f"{c}_scaled") - F.col(f"{c}_recon"), 2) for c in cols}
    tot = None
    for e in sq.values():
        tot = e if tot is None else tot + e
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("original_value"),
                               F.col(f"{c}_scaled").alias("scaled_value"),
                               F.col(f"{c}_recon").alias("reconstructed_scaled"),
                               sq[c].alias("squared_error")) for c in cols])
    return (scored.select(key, F.inline(items), tot.alias("_tot"))
            .withColumn("contribution_pct", F.when(F.col("_tot") > 0, 100.0 * F.col("squared_error") / F.col("_tot")))
            .drop("_tot"))
