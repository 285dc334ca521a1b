import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kassa.operators import anomaly as A
from kassa.operators import autoencoder as AE


def test_percentile_fixture_and_strict_flag(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 10])], "row_id long, reconstruction_error double")
    thr = A.exact_quantile(df, "reconstruction_error", 0.95)
    assert thr == pytest.approx(8.95)
    flagged = [r.row_id for r in A.flag(df, thr).filter("is_anomaly").collect()]
    assert flagged == [3]


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile_refinement_matches_numpy(spark, p):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=700), np.full(400, 0.123)])     # a heavy repeated value
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = A.exact_quantile(df, "x", p, buckets=8)
    assert got == pytest.approx(float(np.percentile(v, p * 100)), abs=1e-12)


def test_exact_quantile_with_infinities_and_wide_range(spark):
    inf = float("inf")
    v = [inf, -inf, 1e308, -1e308, 5e-324, 0.0] + [float(i) for i in range(95)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double")
    s = sorted(v)
    for r in (0, 1, 2, 3, 50, 98, 99, 100):
        assert A.exact_quantile(df, "x", r / 100) == s[r]
    assert A.exact_quantile(df.limit(0), "x", 0.5) is None


def test_alignment_pads_and_contributions_sum_to_100(spark):
    cols = [f"feature_{i}" for i in range(4)]
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(50)]
    df = spark.createDataFrame(data, "row_id long, a double, b double, c double")
    al = A.align_for_scoring(df, cols)
    assert al.columns == ["row_id", *cols] and al.agg(F.max("feature_3")).first()[0] == 0.0
    scaler = A.fit_scaler(al, cols)
    assert scaler.scale[3] == 1.0                    # zero std -> 1
    scored = A.score_linear(al, scaler, A.neighbour_decoder(4))
    c = A.contributions(scored, cols).groupBy("row_id").agg(F.sum("contribution_pct").alias("s"))
    assert all(abs(r.s - 100.0) < 1e-9 for r in c.collect() if r.s is not None)
    assert scored.agg(F.min("reconstruction_error")).first()[0] >= 0


def test_autoencoder_gradient_is_exact():
    rng = np.random.default_rng(0)
    sizes = AE.layer_sizes(5, 3)
    params = AE.init_params(sizes, 1)
    x = rng.normal(size=(7, 5))
    _, grads = AE.grad_sums(x, params)
    flat, g = AE.flatten(params), AE.flatten(grads)
    for idx in rng.choice(flat.size, 12, replace=False):
        e = np.zeros_like(flat); e[idx] = 1e-6
        up = AE.grad_sums(x, AE.unflatten(flat + e, sizes))[0]
        dn = AE.grad_sums(x, AE.unflatten(flat - e, sizes))[0]
        assert (up - dn) / 2e-6 == pytest.approx(g[idx], rel=1e-4, abs=1e-6)


def test_autoencoder_trains(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 2))
    x = np.hstack([z, z @ rng.normal(size=(2, 4))]) + 0.01 * rng.normal(size=(400, 6))
    cols = [f"feature_{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in cols))
    scaler = A.fit_scaler(df, cols)
    m = AE.fit_autoencoder(df, scaler, epochs=40, lr=0.01)
    assert m.history[-1][1] < m.history[0][1]
    s = AE.score(m, df)
    assert s.count() == 400 and s.agg(F.min("reconstruction_error")).first()[0] >= 0


def _plane(spark, n=500, d=5):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(n, 2))
    x = np.hstack([z, z @ rng.normal(size=(2, d - 2))]) + 0.05 * rng.normal(size=(n, d))
    cols = [f"feature_{i}" for i in range(d)]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in cols)), cols


def test_training_does_not_depend_on_partitions(spark, monkeypatch):
    df, cols = _plane(spark)
    scaler = A.fit_scaler(df, cols)
    monkeypatch.setattr(AE, "BLOCK_ROWS", 16)  # several blocks to a batch
    one, many = (AE.fit_autoencoder(df.repartition(n), scaler, epochs=3, batch_rows=100) for n in (2, 16))
    assert np.array_equal(one.weights, many.weights) and one.history == many.history
    monkeypatch.setattr(AE, "FAN_IN", 2)  # sums in two levels
    two = AE.fit_autoencoder(df, scaler, epochs=3, batch_rows=100)
    assert np.allclose(one.weights, two.weights, rtol=0, atol=1e-9)


def test_steps_are_those_of_the_whole_batches(spark):
    """The first epoch against plain numpy on the same batches."""
    df, cols = _plane(spark, 300)
    scaler = A.fit_scaler(df, cols)
    got = AE.fit_autoencoder(df, scaler, epochs=1, batch_rows=60)
    steps = 4
    cut = A.exact_quantile(df, "row_id", 0.8)
    z = F.array(*scaler.columns_scaled().values())
    rows = df.select("row_id", z.alias("z"), F.pmod(F.xxhash64("row_id", F.lit(42)), F.lit(steps)).alias("b")).orderBy("row_id").collect()
    w = AE.flatten(AE.init_params(AE.layer_sizes(5), 42))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t, i in enumerate(np.random.default_rng(42).permutation(steps), 1):
        x = np.array([r["z"] for r in rows if r["b"] == i and r["row_id"] <= cut])
        g = AE.flatten(AE.grad_sums(x, AE.unflatten(w, AE.layer_sizes(5)))[1]) / x.size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.001 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
    assert np.allclose(got.weights, w, rtol=0, atol=1e-9)


def test_a_step_has_no_more_tasks_than_blocks(spark, monkeypatch):
    df, cols = _plane(spark, 300)
    scaler, seen = A.fit_scaler(df, cols), []
    made = AE._Batch.__init__

    def look(self, packed, batch, blocks, d):
        made(self, packed, batch, blocks, d)
        seen.append((self.rdd.getNumPartitions(), blocks))

    monkeypatch.setattr(AE._Batch, "__init__", look)
    AE.fit_autoencoder(df.repartition(8), scaler, epochs=1, batch_rows=60)
    assert len(seen) == 5 and all(tasks <= blocks == 1 for tasks, blocks in seen)
    seen.clear()
    monkeypatch.setattr(AE, "BLOCK_ROWS", 16)
    AE.fit_autoencoder(df.repartition(8), scaler, epochs=1, batch_rows=60)
    assert all(tasks <= blocks and blocks > 1 for tasks, blocks in seen)


def _jobs(spark, run):
    """Spark jobs that ``run`` starts (without adaptive execution, which makes a job of every stage)."""
    import uuid
    group = uuid.uuid4().hex
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_quantile_takes_three_jobs(spark):
    rng = np.random.default_rng(12)
    n = 150_000
    columns = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float),
               "half": np.where(rng.random(n) < 0.5, 1.0, rng.exponential(size=n)), "wide": np.exp(rng.normal(0, 100, n)),
               "infinite": np.where(rng.random(n) < 0.3, np.inf, -rng.random(n))}
    for name, v in columns.items():
        df = spark.createDataFrame(pd.DataFrame({"x": v}))
        s = np.sort(v)
        for p in (0.31, 0.5, 0.95):
            got, jobs = _jobs(spark, lambda: A.exact_quantile(df, "x", p))
            r = int(np.floor((n - 1) * p))
            want = s[r] if s[r] == s[min(r + 1, n - 1)] or (n - 1) * p == r else s[r] + ((n - 1) * p - r) * (s[r + 1] - s[r])
            assert got == want or got == pytest.approx(want, rel=1e-12), (name, p)
            assert jobs <= 3, (name, p, jobs)
