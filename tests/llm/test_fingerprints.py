import hashlib
import random

from pyspark.sql import functions as F

from kassa.llm import fingerprints
from llm_helpers import shingles


def brute_edit(rows):
    """{key: (n, sha of edited, edited)} in ascending key order."""
    rows = sorted(rows)
    out = {}
    for i, (k, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(i + 1) % len(rows)][1][:cut]
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_equals_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(500)]
    texts = {i * 3: " ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 5, 30, 300, 900]))) for i in range(60)}
    texts |= {500: "", 501: "  \n", 502: texts[0], 503: texts[0].replace("w", "W"), 504: "x"}
    rows = [(k, t, 1) for k, t in texts.items()] + [(506, None, 1), (500, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("packed", F.lit(0))
    got = [r.asDict() for r in fingerprints.fingerprint_with_edits(docs).collect()]
    assert len(got) == len(rows)
    texts[506] = ""
    want, order = brute_edit(texts.items()), sorted(texts)
    by = {r["doc_id"]: r for r in got}
    for i, k in enumerate(order):
        n, sha, edited = want[k]
        r, following = by[k], texts[order[(i + 1) % len(order)]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - jaccard(texts[k], edited)) < 0.16
        assert abs(r["near_next"] - jaccard(texts[k], following)) < 0.16
    assert by[0]["fingerprint"] == by[502]["fingerprint"] == by[503]["fingerprint"] != by[3]["fingerprint"]
    assert by[500]["fingerprint"] == by[501]["fingerprint"] == by[506]["fingerprint"] == fingerprints.EMPTY
    errors = [by[k]["near_edited"] - jaccard(texts[k], want[k][2]) for k in order]
    assert abs(sum(errors) / len(errors)) < 0.02  # chance agreement is taken out


def test_one_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprints.fingerprint_with_edits(docs).collect()[0]
    assert r["doc_id"] is None and r["near_next"] == 1.0
    assert fingerprints.fingerprint_with_edits(docs.limit(0)).count() == 0
