import math
import random

import numpy as np
from pyspark.sql import functions as F

from kassa.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Sorted result rows from plain values; rows: (id, vector, label)."""
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows
           if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, l) in enumerate(use):
        if i is None or i % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, m) for k, (j, w, m) in enumerate(use) if k != n),
                        key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for ps, j, _ in [x for x in scored if x[2] == l][:5]:
            fit = [(s, k) for s, k, m in scored if m != l and 30 * ps <= 100 * s <= 90 * ps][:10]
            out += [(i, j, r, k, ps, s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(map(repr, out))


def mined(spark, rows, **columns):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in columns.items()})
    out = hn.mine(df.repartition(5), F.col("key") % 100 == 0)
    return sorted(map(repr, map(tuple, out.collect())))


def vectors(n, d, seed, spread=1.0):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        l = draw.randrange(4)
        long = draw.lognormvariate(0, spread)
        rows.append((i, [long * 0.1 * (m + draw.gauss(0, 0.7)) for m in middle[l]], l))
    return rows


def test_equals_plain_search(spark):
    for d, spread in ((3, 1.5), (16, 0.3)):
        rows = vectors(900, d, d, spread)
        assert mined(spark, rows) == brute(rows)


def test_ties_nulls_and_clashing_columns(spark):
    rows = vectors(300, 4, 1)
    same = [0.5, 0.25, 0.0, -0.1]
    rows += [(1000 + i, same, i % 3) for i in range(120)]  # equal vectors: ties go to the smaller id
    rows += [(200, same, 1), (200, same, 1), (None, same, 1), (None, same, 2)]
    rows += [(400, None, 1), (500, same, None), (600, [float("nan")] + same[1:], 1), (700, [1.0, None, 0.0, 0.0], 1),
             (800, [float("inf")] * 4, 2), (900, [], 1), (1100, [0.0] * 4, 2), (1300, same[:2], 0), (1400, same * 2, 1)]
    assert mined(spark, rows, key="x", v=1, length=2, score=3, slot=4, rank=5, anchor=6, row=7, _uid=8, _part=9) == brute(rows)


def test_large_values_are_exact(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(2e5, 2.6e5) for _ in range(8)], i % 2) for i in range(0, 4000, 20)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_pruning_keeps_every_vector_that_reaches_the_bar():
    draw = np.random.default_rng(4)
    v = np.floor(draw.normal(0, 60, (1500, 5)))
    length = np.linalg.norm(v, axis=1)
    n = len(v)
    bucket = hn.Bucket(v, length, np.zeros(n), np.arange(n), np.zeros(n, bool), np.arange(n))
    q = np.concatenate([v[:40], np.floor(draw.normal(0, 60, (40, 5)))])
    size = np.linalg.norm(q, axis=1)
    unit = q / size[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :hn.FOCUS]
    angles = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
    for share in (0.2, 0.6, 0.9, 1.0):
        bar = share * size * length.max()
        use = bucket.candidates(focus, angles, np.arccos(np.clip(bar / (size * length.max()), -1, 1)) + 1e-7)
        assert not (((q @ v.T) >= bar[:, None]) & ~use).any()
        assert share < 0.9 or use.mean() < 0.2  # most are ruled out without a score
