import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kassa.llm import quality_classifier as qc

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = qc.classify(docs.join(known.select("doc_id"), "doc_id", "left_semi"), labels).select(
        "row.doc_id", "held_out", "score", "predicted").join(known, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert held[held.quality == 1].predicted.mean() > 0.99      # good documents stay
    p = np.where(held.quality == 1, held.score, 1 - held.score)
    assert -np.log(np.maximum(p, 1e-9)).mean() < 0.12           # calibrated


def test_scores_follow_the_text_alone(spark):
    good, bad = "some plain words in a row that read well", "WORDS!! ### OF!! *** SHOUTING!! $$$"
    rows = [(i, good if i % 2 else bad, "en", f"src{i % 2}", 1) for i in range(40)]
    rows += [(100, good, "xx", None, None), (101, None, None, None, None), (102, "", "en", "s", 0), (None, bad, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(0, 7, 0), (100, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["row"]["doc_id"]: r for r in qc.classify(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[100]["score"] == out[1]["score"] and out[None]["score"] == out[0]["score"] and out[None]["held_out"]
    assert out[101]["score"] == out[102]["score"]
    kept = qc.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(40) if i % 2}
    assert qc.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("labels, want", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_one_class_or_none(labels, want):
    model = qc.fit(["a b"] * len(labels), np.array(labels, np.int64))
    assert model.scores(["x", None], qc._Rows(model.vocabulary)).tolist() == [want, want]
