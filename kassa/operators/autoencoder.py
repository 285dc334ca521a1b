"""The reference's dense autoencoder (d-32-16-k-16-32-d, ReLU, linear output, MSE,
Adam, learning rate 0.001) trained synchronously on Spark: one Adam step per mini-batch of the whole data.

A row's mini-batch and its block in it are hashes of its key.  A mini-batch has ``batch_rows`` rows, or more on
large data: an epoch has at most ``STEPS`` steps, so its number of jobs does not grow.  A block has
about ``BLOCK_ROWS`` rows, sorted by key, packed as one array.  A step is one job with no more tasks than the
mini-batch has blocks: the weights (a few thousand numbers) go out with it, every block yields its gradient sum,
blocks are summed in the order of their numbers, in two levels (``FAN_IN`` sums reach the driver at most), and
the driver makes the Adam step.

Neither the number of partitions nor that of cores changes what is summed with what, or in which order, so
the weights are the same on every cluster, to the last bit.  Packed blocks are cached and come from a
written table, from which lost ones are read again.  Validation = rows above the 80th percentile of the key (the
reference holds out the last 20%); early stopping with patience keeps the best weights.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.operators.anomaly import Scaler, exact_quantile, mean_squared
from kassa.session import scratch_path


def layer_sizes(d: int, k: int | None = None) -> list[int]:
    k = k or max(3, d // 3)
    return [d, 32, 16, k, 16, 32, d]


def init_params(sizes: list[int], seed: int = 42) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / (a + b))                      # Glorot uniform, zero bias
        out += [rng.uniform(-lim, lim, size=(a, b)), np.zeros(b)]
    return out


def flatten(params) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def unflatten(vec: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, i = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(vec[i:i + a * b].reshape(a, b)); i += a * b
        out.append(vec[i:i + b]); i += b
    return out


def forward(x: np.ndarray, params) -> tuple[np.ndarray, list]:
    acts = [x]
    h = x
    n_layers = len(params) // 2
    for li in range(n_layers):
        z = h @ params[2 * li] + params[2 * li + 1]
        h = z if li == n_layers - 1 else np.maximum(z, 0.0)
        acts.append(h)
    return h, acts


def grad_sums(x: np.ndarray, params) -> tuple[float, list[np.ndarray]]:
    """Sum of squared errors and its gradient (un-normalised) for one batch."""
    out, acts = forward(x, params)
    diff = out - x
    sse = float(np.sum(diff * diff))
    g = 2.0 * diff
    grads = [None] * len(params)
    n_layers = len(params) // 2
    for li in reversed(range(n_layers)):
        grads[2 * li] = acts[li].T @ g
        grads[2 * li + 1] = g.sum(axis=0)
        if li:
            g = (g @ params[2 * li].T) * (acts[li] > 0)
    return sse, grads


@dataclass
class AutoencoderModel:
    scaler: Scaler
    sizes: list[int]
    weights: np.ndarray
    history: list[tuple[int, float, float]]

    def params(self):
        return unflatten(self.weights, self.sizes)


#: most steps (jobs) of an epoch, rows of a packed block, and sums that reach the driver
STEPS, BLOCK_ROWS, FAN_IN = 64, 1 << 14, 64
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7
VALIDATION = -1


def _packed(df: DataFrame, scaler: Scaler, key: str, cut: float, steps: int, blocks: int, seed: int) -> DataFrame:
    """(batch, block, z): the scaled rows of a block as one array, in the order of their keys; the validation
    rows are batch ``VALIDATION``.  A folder per batch, so that a batch is read without the others."""
    draw = F.xxhash64(F.col(key), F.lit(seed))
    batch = F.when(F.col(key) > F.lit(cut), VALIDATION).otherwise(F.pmod(draw, F.lit(steps))).cast("int")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(blocks)).cast("int")
    z = F.array(*[c.cast("double") for c in scaler.columns_scaled().values()])
    rows = df.select(batch.alias("batch"), block.alias("block"), F.col(key).alias("key"), z.alias("z"))
    rows = rows.repartition("batch", "block").sortWithinPartitions("batch", "block", "key", "z")

    def pack(batches):
        at, held = None, []

        def packed():
            return pd.DataFrame({"batch": [at[0]], "block": [at[1]], "z": [np.concatenate(held).tobytes()]})

        for pdf in batches:
            for place, rows_ in pdf.groupby(["batch", "block"], sort=True)["z"]:
                if place != at:
                    if held:
                        yield packed()
                    at, held = place, []
                held.append(np.stack(rows_.to_numpy()))
        if held:
            yield packed()

    path = scratch_path(df.sparkSession, "packed")
    out = rows.select("batch", "block", "z").mapInPandas(pack, "batch int, block int, z binary")
    out.write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema("block int, z binary, batch int").parquet(path)


class _Batch:
    """One mini-batch (or the validation rows) as a cached set of packed blocks."""

    def __init__(self, packed: DataFrame, batch: int, blocks: int, d: int):
        # gradients of FAN_IN groups of blocks; with as few blocks every group is one
        self.blocks, self.group = blocks, -(-blocks // FAN_IN)
        # a step is a job: tasks without a block would be most of its time
        rows = packed.where(F.col("batch") == batch).select("block", "z").coalesce(blocks).rdd
        self.rdd = rows.map(lambda r: (r["block"], np.frombuffer(r["z"]).reshape(-1, d)))
        self.rdd = self.rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, of) -> list | None:
        """The sum of ``of(block)`` (a list of arrays) over all blocks, always added in the same order."""
        group = self.group
        done = self.rdd.map(lambda b: (b[0], of(b[1])))
        if group > 1:
            def add(items):
                return _total(v for _, v in sorted(items, key=lambda x: x[0]))
            done = done.map(lambda b: (b[0] // group, b)).groupByKey(FAN_IN).mapValues(add)
        return _total(v for _, v in sorted(done.collect(), key=lambda x: x[0]))


def _total(values):
    out = None
    for v in values:
        out = list(v) if out is None else [a + b for a, b in zip(out, v)]
    return out


def fit_autoencoder(df: DataFrame, scaler: Scaler, key: str = "row_id", k: int | None = None, epochs: int = 100,
                    lr: float = 0.001, batch_rows: int = 64, patience: int = 10, validation: float = 0.2,
                    seed: int = 42) -> AutoencoderModel:
    d = len(scaler.columns)
    sizes = layer_sizes(d, k)
    cut = exact_quantile(df, key, 1.0 - validation)
    n = df.count()
    steps = int(min(STEPS, max(1, -(-n * (1.0 - validation) // batch_rows))))
    blocks = int(max(1, -(-n // (steps * BLOCK_ROWS))))
    packed = _packed(df, scaler, key, cut, steps, blocks, seed)
    batches = [_Batch(packed, i, blocks, d) for i in range(steps)]
    held = _Batch(packed, VALIDATION, blocks, d)
    w = flatten(init_params(sizes, seed))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    best, best_w, wait, history = np.inf, w.copy(), 0, []
    draw = np.random.default_rng(seed)
    try:
        for epoch in range(1, epochs + 1):
            tr_sse = tr_n = 0.0
            for i in draw.permutation(steps):
                def gradient(x, weights=w):
                    sse, grads = grad_sums(x, unflatten(weights, sizes))
                    return [flatten(grads), sse, len(x)]

                total = batches[i].sums(gradient)
                if total is None:
                    continue
                g, sse, rows = total
                t += 1
                g = g / (rows * d)
                m = BETA1 * m + (1 - BETA1) * g
                v = BETA2 * v + (1 - BETA2) * g * g
                w = w - lr * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPSILON)
                tr_sse, tr_n = tr_sse + sse, tr_n + rows
            if not tr_n:
                break
            weights = w

            def error(x, weights=weights):
                out, _ = forward(x, unflatten(weights, sizes))
                return [float(np.sum((out - x) ** 2)), len(x)]

            total = held.sums(error)
            tr_loss = tr_sse / (tr_n * d)
            va_loss = total[0] / (total[1] * d) if total else tr_loss
            history.append((epoch, float(tr_loss), float(va_loss)))
            if va_loss < best - 1e-12:
                best, best_w, wait = va_loss, w.copy(), 0
            else:
                wait += 1
                if wait >= patience:
                    break
    finally:
        for b in [*batches, held]:
            b.rdd.unpersist()
    return AutoencoderModel(scaler, sizes, best_w, history)


def score(model: AutoencoderModel, df: DataFrame, key: str = "row_id") -> DataFrame:
    """M16 for the network: key, <f>, <f>_scaled, <f>_recon, reconstruction_error (one mapInPandas)."""
    cols = model.scaler.columns
    zc = [f"{c}_scaled" for c in cols]
    sizes, wv = model.sizes, model.weights
    scaled = df.withColumns(model.scaler.columns_scaled()).select(key, *cols, *zc)

    def run(batches):
        params = unflatten(wv, sizes)
        for pdf in batches:
            out, _ = forward(pdf[zc].to_numpy(dtype=float), params)
            error = mean_squared(pdf[zc].to_numpy(dtype=float), out)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=[f"{c}_recon" for c in cols]),
                             pd.DataFrame({"reconstruction_error": error})], axis=1)

    schema = scaled.schema
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(schema.fields + [StructField(c, DoubleType()) for c in
                                         [*(f"{c}_recon" for c in cols), "reconstruction_error"]])
    return scaled.mapInPandas(run, schema)
