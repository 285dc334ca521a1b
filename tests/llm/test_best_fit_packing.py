import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kassa.llm import best_fit_packing as packing
from kassa.llm.common import Scratch
from llm_helpers import docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(spark, sizes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "uid long, size long")
    at = {r["uid"]: (r["sequence_id"], r["offset"]) for r in packing.place(Scratch(spark, "t"), df).collect()}
    assert sorted(at) == list(range(len(sizes)))
    by = {}
    for i, s in enumerate(sizes):
        by.setdefault(at[i][0], []).append((at[i][1], s))
    for parts in by.values():  # gapless from 0, within capacity
        end = 0
        for offset, s in sorted(parts):
            assert offset == end
            end += s
        assert end <= packing.CAPACITY
    return len(by)


def first_fit_decreasing(sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g[0] >= s]
        if fit:
            min(fit)[0] -= s
        else:
            gaps.append([packing.CAPACITY - s])
    return len(gaps)


def test_as_few_as_sequential_best_fit(spark):
    draw = random.Random(6)
    sizes = [min(4096, int(draw.lognormvariate(6.4, 0.9)) + 1) for _ in range(1500)] + [4096] * 5
    assert placed(spark, sizes) <= first_fit_decreasing(sizes) + 2


def test_equal_and_tiny_sizes(spark):
    assert placed(spark, [1] * 9000) == 3
    assert placed(spark, [1365] * 600) == 200
    assert placed(spark, [2049] * 40 + [2047] * 40) == 40
    assert placed(spark, [4095] * 3 + [1]) == 3


def test_tiny_pieces_fill_open_gaps_before_new_sequences(spark):
    # 10 tokens fit 409 times; the long ones leave room for 109 each
    assert placed(spark, [10] * 40_000 + [3000] * 5) == -(-(40_000 - 5 * 109) // 409) + 5
    draw = random.Random(9)
    sizes = [min(4096, int(draw.lognormvariate(2.5, 1.2)) + 1) for _ in range(20_000)] + [3000] * 9 + [2500] * 4
    assert placed(spark, sizes) <= first_fit_decreasing(sizes) + 2


def test_rounds_are_read_in_one_scan(spark):
    draw = random.Random(6)
    sizes = [min(4096, int(draw.lognormvariate(6.4, 0.9)) + 1) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, size long")
    scratch = Scratch(spark, "t")
    out = packing.place(scratch, df)
    assert scratch._n > 3  # tables of more than one round
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_ids_equal_library(spark):
    library = Tokenizer.from_file(PATH)
    draw = random.Random(2)
    letters = list("abcXYZ'sé́ \n\t\xa0 \x1c\x85.,!?漢ΣΑΣ123😀") + ["<|endoftext|>", " <|startoftext|>x", "don't "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 10, 50]))) for _ in range(400)]
    texts += [None, "", "", "the cat " * 5000]
    docs = docs_of(spark, texts).withColumns({"uid": F.lit(1), "size": F.lit(2), "piece": F.lit(3)})
    rows = sorted(packing.pack(docs, PATH).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at: at + 4096], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert [tuple(r)[:5] for r in rows] == want


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, ["x"]).limit(0), PATH).count() == 0


def test_remembered_words_keep_their_ids(spark, monkeypatch):
    """The frequent words stay remembered, and halves that fill up change no ids."""
    library = Tokenizer.from_file(PATH)
    draw = random.Random(9)
    common = ["the", "cat,", "sat.", "İ,", "don't,", "é***", "x''", "A&&&", "3$", "Å.", "…,", "a̸=", "<|endoftext|>."]
    texts = ["", None, "  ", "the"] + [" ".join(draw.choice(common) if draw.random() < 0.5 else "".join(
        draw.choices("abcdeé", k=9)) + draw.choice(["", ",", "###"]) for _ in range(60)) for _ in range(80)]
    monkeypatch.setattr(packing, "WORDS", 400)
    words = packing.WordTokenizer(PATH)
    learned = []
    encoded = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda new: learned.extend(new) or encoded(new))
    for t in texts:
        ids, bounds = words.ids(pa.array([t or ""]))
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]
        assert len(words.known) <= 400
    assert learned.count(b"the") == 1


def test_library_gets_few_new_words_at_once(monkeypatch):
    """What the library makes of words is many times their size, so it never holds those of a whole batch."""
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdeé", k=9)) + draw.choice(["", "", "9x"]) for _ in range(300)) for _ in range(90)]
    library, words, most = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH), []

    class Counting:
        def encode_batch_fast(self, some, **kw):
            most.append(sum(len(s.split()) for s in some))
            return library.encode_batch_fast(some, **kw)

    monkeypatch.setattr(words, "tokenizer", Counting())
    ids, bounds = words.ids(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert len(bounds) == 91 and 0 < max(most) <= 10_000
