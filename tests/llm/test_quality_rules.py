import random

from pyspark.sql import functions as F

from kassa.llm import quality_rules
from kassa.llm.common import Scratch
from llm_helpers import DOC_SCHEMA, WORD


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i: i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_measures_equal_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choice(["a ", "b ", "a b c ", "x\n", "#|", "é\x85", "\t", "\x1f", "\u2028", "😀 "])
                       for _ in range(draw.choice([0, 1, 2, 3, 5, 30, 200])))
        assert quality_rules.measure_text(text) == brute(text)
    assert quality_rules.measure_text(None) == brute(None)
    long = "word " * 200_000
    assert quality_rules.measure_text(long)[4] == 200_000


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "bad", 5) for i in range(40)] + [(100, good, "en", "bad", 1)]
    for s in ("a", "b", None):
        rows += [(200 + len(rows) + i, good, "en", s, 1) for i in range(30)]
    rows += [(900, None, None, "a", None), (901, "", "en", "a", 0), (902, "short", "en", None, 5)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumns({"m": F.lit(1), "salt": F.lit(2), "kept": F.lit(3)})
    out = {r["row"]["doc_id"]: r for r in quality_rules.judge(
        Scratch(spark, "t"), docs, "text", "source", docs.columns).collect()}
    assert len(out) == len(rows)
    assert not out[100]["base_failed"] and not out[100]["kept"]
    assert {i for i, r in out.items() if r["kept"]} == {r[0] for r in rows if r[0] >= 200 and r[0] < 900}
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and kept.count() == 90


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert quality_rules.apply_rules(docs).count() == 0
