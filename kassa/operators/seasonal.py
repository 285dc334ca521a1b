"""Seasonal-trend forecast per series: a trend whose slope may change, daily, weekly and
yearly Fourier seasonality (after Taylor & Letham 2018).

The model is linear: intercept, slope, Fourier terms and one hinge (t - s_j)+ for every possible change, at
``CHANGES`` even places in the first 80% of the history.  Coefficients have normal priors, slope changes a
Laplace prior, so the fit is a ridge regression with an L1 penalty on the hinges: most slopes do not change.

Spark does the data work.  Transactions are reduced to daily series by one aggregate; the rows'
cross products (Gram matrices of p + 1 columns) are summed per series and stretch of days where the rows
are, and per series after that, so no series' rows are gathered.  What is solved is one small matrix per
series: the ridge part is eliminated exactly, coordinate descent finds which hinges move, and one linear solve on
those gives their sizes.  The noise's variance, which scales the penalties, is re-estimated a few times.

Prediction over history and future dates is a join with the coefficient table and a dot product in column
expressions.  The interval is +- z noise deviations over the history; over the future it has the
quantiles of simulated paths whose slope goes on changing as often and as much as it did (seeded by the
series' name, so a second run gives the same).
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.operators.forecast import Z

# Fourier orders of the day, week and year.
PERIODS = ((1.0, 4), (7.0, 3), (365.25, 10))
# Possible slope changes, the share of the history they lie in, and the scales of the priors.
CHANGES, CHANGE_RANGE = 25, 0.8
TREND_SCALE, SEASON_SCALE, CHANGE_SCALE = 5.0, 10.0, 0.05
# Days of one partial sum, rounds of re-estimating the noise, simulated paths.
STRETCH, ROUNDS, PATHS = 4096, 4, 1000


def n_ridge() -> int:
    return 2 + 2 * sum(order for _, order in PERIODS)


def n_terms() -> int:
    return n_ridge() + CHANGES


def change_places() -> list[float]:
    """Times (0 to 1) at which the slope may change."""
    return [CHANGE_RANGE * (j + 1) / (CHANGES + 1) for j in range(CHANGES)]


def days_since_epoch(ds: Column) -> Column:
    """Days with their fraction; dates are midnights."""
    return F.unix_micros(ds.cast("timestamp")) / F.lit(86_400e6)


def _design(day: Column, t: Column) -> list[Column]:
    """Columns of one design row: intercept, trend, Fourier terms, hinges."""
    cols = [F.lit(1.0), t]
    for period, order in PERIODS:
        for k in range(1, order + 1):
            ang = day * F.lit(2.0 * math.pi * k / period)
            cols += [F.sin(ang), F.cos(ang)]
    return cols + [F.greatest(t - F.lit(s), F.lit(0.0)) for s in change_places()]


def _with_design(df: DataFrame, spans: DataFrame) -> DataFrame:
    """``_x``: the design row as an array; ``spans`` has series_key, _day0, _span."""
    d = df.join(spans, "series_key").withColumn("_day", days_since_epoch(F.col("ds")))
    t = ((F.col("_day") - F.col("_day0")) / F.col("_span")).cast("double")
    return d.withColumn("_x", F.array(*_design(F.col("_day"), t)))


def _dot(x: str, beta: str) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cross_products(d: DataFrame) -> DataFrame:
    """(series_key, sums): per series the sums of all products of design columns and y, flattened."""
    size = n_terms() + 1
    # a stretch of days, not a series, is what one task must have together
    rows = d.select("series_key", F.floor(F.col("_day") / STRETCH).alias("stretch"), "_x", (F.col("y") / F.col("_scale")).alias("y"))
    rows = rows.repartition("series_key", "stretch").sortWithinPartitions("series_key", "stretch")

    def partial(batches):
        at, total = None, None
        for pdf in batches:
            for place, part in pdf.groupby(["series_key", "stretch"], sort=False):
                z = np.column_stack([np.stack(part["_x"].to_numpy()), part["y"].to_numpy(float)])
                if at is not None and place != at:
                    yield pd.DataFrame({"series_key": [at[0]], "stretch": [at[1]], "sums": [total.ravel()]})
                total = z.T @ z if place != at else total + z.T @ z
                at = place
        if at is not None:
            yield pd.DataFrame({"series_key": [at[0]], "stretch": [at[1]], "sums": [total.ravel()]})

    parts = rows.mapInPandas(partial, "series_key string, stretch long, sums array<double>")
    # one array per stretch of 4,096 days, added in their order
    held = F.array_sort(F.collect_list(F.struct("stretch", "sums")))
    zero = F.array_repeat(F.lit(0.0), size * size)
    return parts.groupBy("series_key").agg(held.alias("parts")).select("series_key", F.aggregate(
        "parts", zero, lambda s, p: F.zip_with(s, p["sums"], lambda a, b: a + b)).alias("sums"))


def descend(m: np.ndarray, c: np.ndarray, penalty: float, sweeps: int = 200) -> np.ndarray:
    """The minimum of x'mx/2 - c'x + penalty |x|_1.

    Coordinate descent comes close; then the support is settled exactly: solve for the coordinates that moved
    with their signs, stop on the way where one reaches zero (and drop it), and add the coordinate
    whose gradient exceeds the penalty most, until none does.
    """
    x, miss = np.zeros(len(c)), c.copy()  # miss = c - m x
    size = np.diag(m)
    move = np.flatnonzero(size > 1e-12)
    for _ in range(sweeps):
        largest = 0.0
        for j in move:
            at = miss[j] + size[j] * x[j]
            new = math.copysign(max(abs(at) - penalty, 0.0), at) / size[j]
            if new != x[j]:
                largest = max(largest, abs(new - x[j]) * size[j])
                miss -= m[:, j] * (new - x[j])
                x[j] = new
        if largest <= 1e-9 * max(penalty, 1e-9):
            break
    sign = np.sign(x)
    for _ in range(20 * len(c) + 20):
        on = np.flatnonzero(sign)
        if len(on):
            target = np.linalg.lstsq(m[np.ix_(on, on)], c[on] - penalty * sign[on], rcond=None)[0]
            crossing = target * sign[on] < 0
            if crossing.any():
                far = x[on][crossing] / (x[on][crossing] - target[crossing])
                x[on] += far.min() * (target - x[on])
                gone = on[crossing][np.argmin(far)]
                x[gone] = sign[gone] = 0
                continue
            x[on] = target
        g = c - m @ x
        g[on] = 0
        worst = np.argmax(np.abs(g))
        if abs(g[worst]) <= penalty * (1 + 1e-9) + 1e-13 or size[worst] <= 1e-12:
            break
        sign[worst] = np.sign(g[worst])
    return x


def solve(sums: np.ndarray, n: int, ridge: float) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, noise variance, penalties) of one series in units of its scale."""
    p, q = n_ridge(), n_terms()
    g = sums.reshape(q + 1, q + 1)
    xx, xh, hh = g[:p, :p], g[:p, p:q], g[p:q, p:q]
    bx, bh, yy = g[:p, q], g[p:q, q], g[q, q]
    scales = np.array([TREND_SCALE] * 2 + [SEASON_SCALE] * (p - 2))
    variance = yy / n
    for _ in range(ROUNDS):
        variance = max(variance, 1e-10)
        own = ridge + variance / scales ** 2
        own[0] = variance / scales[0] ** 2  # the intercept has its prior only
        penalty = variance / CHANGE_SCALE
        a = xx + np.diag(own)
        out = np.linalg.solve(a, np.column_stack([xh, bx]))
        m = hh - xh.T @ out[:, :-1]
        delta = descend((m + m.T) / 2, bh - xh.T @ out[:, -1], penalty)
        beta = np.concatenate([out[:, -1] - out[:, :-1] @ delta, delta])
        # g without its last row and column is the design's own Gram matrix
        fitted = float(yy - 2 * beta @ g[:q, q] + beta @ g[:q, :q] @ beta) / n
        variance = fitted
    return beta, max(variance, 0.0), np.append(own, penalty)


def fit_seasonal(daily: DataFrame, ridge: float = 1e-3, min_points: int = 30) -> DataFrame:
    """Coefficients per series: series_key, beta array (in units of _scale), sigma, n, _day0, _span, _scale, and
    the ridge and L1 penalties of the last round."""
    day = days_since_epoch(F.col("ds"))
    spans = daily.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("_day0"), F.greatest(F.max(day) - F.min(day), F.lit(1.0)).alias("_span"),
        F.greatest(F.max(F.abs("y")), F.lit(1e-9)).alias("_scale")).where(F.col("n") >= min_points)
    sums = cross_products(_with_design(daily.select("series_key", "ds", "y"), spans))
    # one row per series
    table = spans.join(sums, "series_key")
    schema = "series_key string, n long, _day0 double, _span double, _scale double, beta array<double>, sigma double, penalties array<double>"

    def run(batches):
        for pdf in batches:
            solved = [solve(np.asarray(s, float), n, ridge) for s, n in zip(pdf["sums"], pdf["n"])]
            yield pdf.drop(columns="sums").assign(
                beta=[b.tolist() for b, _, _ in solved], penalties=[p.tolist() for _, _, p in solved],
                sigma=[math.sqrt(v) * s for (_, v, _), s in zip(solved, pdf["_scale"])])

    return table.select("series_key", "n", "_day0", "_span", "_scale", "sums").mapInPandas(run, schema)


def trend_changes(coef: DataFrame) -> DataFrame:
    """Every slope change that was found: series_key, place (0 to 1), day (since the epoch), slope_change per day."""
    places = F.array(*[F.lit(s) for s in change_places()])
    hinges = F.slice("beta", n_ridge() + 1, CHANGES)
    found = coef.select("*", F.explode(F.arrays_zip(places.alias("place"), hinges.alias("delta"))).alias("c"))
    return found.where("c.delta != 0").select(
        "series_key", F.col("c.place").alias("place"), (F.col("_day0") + F.col("c.place") * F.col("_span")).alias("day"),
        (F.col("c.delta") * F.col("_scale") / F.col("_span")).alias("slope_change"))


def simulated_spread(coef: DataFrame, days: int, level: float, seed: int = 42) -> DataFrame:
    """(series_key, step, low, high): quantiles of noise and future slope changes, one row per future day."""
    p = n_ridge()

    def run(batches):
        for pdf in batches:
            for name, beta, sigma, span, scale in zip(pdf["series_key"], pdf["beta"], pdf["sigma"], pdf["_span"], pdf["_scale"]):
                draw = np.random.default_rng([seed, zlib.crc32(name.encode())])
                size = float(np.mean(np.abs(np.asarray(beta)[p:]))) + 1e-8
                changes = draw.laplace(0, size, (PATHS, days)) * (draw.random((PATHS, days)) < min(1.0, CHANGES / span))
                path = np.cumsum(np.cumsum(changes, axis=1), axis=1) * scale / span + draw.normal(0, 1, (PATHS, days)) * sigma
                low, high = np.quantile(path, [(1 - level) / 2, (1 + level) / 2], axis=0)
                yield pd.DataFrame({"series_key": name, "step": np.arange(1, days + 1), "low": low, "high": high})

    return coef.select("series_key", "beta", "sigma", "_span", "_scale").mapInPandas(
        run, "series_key string, step long, low double, high double")


def forecast_seasonal(daily: DataFrame, coef: DataFrame, days: int = 30, z: float = Z) -> DataFrame:
    """History dates + ``days`` future dates per series (M26), with yhat and interval."""
    last = daily.groupBy("series_key").agg(F.max("ds").alias("_m"))
    steps = last.select("series_key", "_m", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"))
    ds = F.date_add("_m", F.col("step")) if isinstance(daily.schema["ds"].dataType, T.DateType) else (
        F.col("_m") + F.make_dt_interval(days=F.col("step")))
    future = steps.select("series_key", ds.alias("ds"), F.col("step").cast("long").alias("step"))
    dates = daily.select("series_key", "ds", F.lit(None).cast("long").alias("step")).unionByName(future)
    spread = simulated_spread(coef, days, math.erf(z / math.sqrt(2)))
    d = _with_design(dates, coef).join(spread, ["series_key", "step"], "left")
    yhat, noise = _dot("_x", "beta") * F.col("_scale"), z * F.col("sigma")
    return d.withColumn("yhat", yhat).select(
        F.col("series_key").alias("category"), "ds", "yhat",
        (F.col("yhat") + F.coalesce(F.least("low", F.lit(0.0)), -noise)).alias("yhat_lower"),
        (F.col("yhat") + F.coalesce(F.greatest("high", F.lit(0.0)), noise)).alias("yhat_upper"))


def normal_residual(daily: DataFrame, coef: DataFrame) -> DataFrame:
    """(series_key, residual): how far ``coef`` is from the minimum, relative to the data's size.

    At the minimum, per term, the sum of x (y - x beta) is the ridge penalty times beta, or for a hinge that
    moved the L1 penalty with its sign, and for one that did not it is at most the L1 penalty.  One aggregate
    over the rows.
    """
    p, q = n_ridge(), n_terms()
    d = _with_design(daily.select("series_key", "ds", "y"), coef)
    miss = F.col("y") / F.col("_scale") - _dot("_x", "beta")
    sums = d.withColumn("_miss", miss).groupBy("series_key").agg(
        F.first("beta").alias("beta"), F.first("penalties").alias("w"),
        F.sum(F.abs(F.col("y") / F.col("_scale"))).alias("_size"),
        *[F.sum(F.col("_x")[i] * F.col("_miss")).alias(f"_g{i}") for i in range(q)])
    l1 = F.col("w")[p]
    worst = [F.abs(F.col(f"_g{i}") - F.col("w")[i] * F.col("beta")[i]) for i in range(p)]
    for i in range(p, q):
        g, b = F.col(f"_g{i}"), F.col("beta")[i]
        worst.append(F.when(b != 0, F.abs(g - l1 * F.signum(b))).otherwise(F.greatest(F.abs(g) - l1, F.lit(0.0))))
    return sums.select("series_key", (F.greatest(*worst) / F.greatest(F.col("_size"), F.lit(1.0))).alias("residual"))
