import hashlib
import random
from fractions import Fraction

from llm_helpers import DOC_SCHEMA, WORD, docs_of
from pyspark.sql import functions as F

from kassa.llm import source_mixing as sm


def brute(rows):
    """{(doc_id, source): (size, target, total copies of equal rows)} from plain values."""
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(n for _, x, n in sizes if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(words.values()) - sum(3 * words[s] for s in full)
        shares = sum(w for s, w in weight.items() if s not in full)
        target = {s: Fraction(3 * words[s]) if s in full else Fraction(left * weight[s], shares) for s in sources}
        above = {s for s in sources if target[s] > 3 * words[s]}
        if not above:
            break
        full |= above
    out = {}
    for k, s in enumerate(sources):
        step = min(int(target[s] / words[s] * 2 ** 32), 3 << 32) if words[s] else 0
        at = int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:8], 16)
        for i, n in sorted(((i, n) for i, x, n in sizes if x == s), key=lambda x: (-x[1], x[0] is not None, x[0] or 0)):
            copies = ((at + step) >> 32) - (at >> 32)
            at += step
            old = out.get((i, s), (n, target[s], 0, 0))
            out[i, s] = (n, target[s], old[2] + copies, old[3] + 1)
    return out


def result(df):
    out = {}
    for r in df.select("row.doc_id", "row.source", "size", "target", "n_copies", "taken").collect():
        assert r["taken"] == r["size"] * r["n_copies"] and 0 <= r["n_copies"] <= 3
        old = out.get((r["doc_id"], r["source"]), (0, 0, 0, 0))
        out[r["doc_id"], r["source"]] = (r["size"], r["target"], old[2] + r["n_copies"], old[3] + 1)
    return out


def test_equals_plain_computation(spark):
    draw = random.Random(1)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(draw.choice([0, 3, 3, 7, 40, 200]))), draw.choice("aaaaaabcdé"))
            for i in range(300)]
    rows += [(300, None, "a"), (301, "", None), (None, "x y", None), (302, "x y", None), (302, "x y", None),
             (303, "only words " * 5, "tiny"), (304, " \t\n", "blank"), (305, "word " * 50_000, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOC_SCHEMA)
    got, want = result(sm.copies(docs)), brute(rows)
    assert got.keys() == want.keys()
    for k, (n, target, copies, m) in want.items():
        assert got[k][0] == n and abs(got[k][1] - float(target)) < 1e-6 * max(1, float(target))
        assert got[k][2:] == (copies, m)


def test_targets_are_met_and_reruns_agree(spark):
    draw = random.Random(2)
    docs = docs_of(spark, ["w " * draw.randint(1, 30) for _ in range(3000)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    out = sm.copies(docs).groupBy("row.source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m"))
    for r in out.collect():
        assert abs(r["k"] - r["t"]) <= r["m"]
    first = sorted(sm.copies(docs).select("row.doc_id", "taken").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(sm.copies(docs.repartition(17)).select("row.doc_id", "taken").collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_mixture_and_clashing_columns(spark):
    names = ["size", "key", "row", "place", "target", "step", "_part", "_uid", "p", "s", "n", "weight", "mark", "start"]
    docs = docs_of(spark, ["a b c", "a b", None, ""] * 5).withColumns({n: F.lit("mine") for n in names})
    taken = sm.copies(docs)
    assert taken.count() == 20 and taken.agg(F.sum("taken")).first()[0] == 25  # one source keeps its words
    copies = sm.mix(docs)
    assert copies.count() == 20 and set(copies.select("row.*").columns) == set(docs.columns)
    assert copies.where("row.weight != 'mine' OR copy != 1").count() == 0


def test_empty_tables(spark):
    assert sm.copies(docs_of(spark, [])).count() == 0 and sm.mix(docs_of(spark, [])).count() == 0
    nothing = sm.copies(docs_of(spark, [None, "", " "]))
    assert [r["taken"] for r in nothing.collect()] == [0, 0, 0]
