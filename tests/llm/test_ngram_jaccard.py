import random

import numpy as np
from pyspark.sql import functions as F

from kassa.llm import ngram_jaccard
from llm_helpers import docs_of, jaccard_groups


def corpus():
    """Random texts, edited copies in chains, a passage that most texts share, a large group of near copies."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = draw.choices(vocabulary, k=60)
    texts = []
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.choice([3, 8, 20, 100, 250]))
        texts.append(words + passage if draw.random() < 0.6 else words)
    for _ in range(120):
        words = list(draw.choice(texts))
        for _ in range(draw.choice([0, 1, 1, 2, 6])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(words)
    base = draw.choices(vocabulary, k=120)
    for _ in range(80):
        words = list(base)
        words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    return [*texts, None, "", " \n\t", "A", "a", "One two", "one TWO", texts[0], texts[0].upper(), "a b c d e", "x " * 5000]


def test_equals_brute_force(spark):
    texts = corpus()
    docs = docs_of(spark, texts).withColumns({"n": F.lit(1), "node": F.lit(2), "token": F.lit(3)})
    want = jaccard_groups(dict(enumerate(texts)))
    got = {r["id"]: (r["n"], r["component"]) for r in ngram_jaccard.groups(docs).collect()}
    assert got == want
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_null_keys_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " more")], "doc_id long, text string")
    assert sorted((str(r["id"]), r["component"]) for r in ngram_jaccard.groups(docs).collect()) == [
        ("7", 7), ("7", 7), ("9", 7), ("None", 7)]
    assert ngram_jaccard.groups(docs.limit(0)).count() == 0
    assert ngram_jaccard.one_of_each(docs.limit(0)).count() == 0


def test_prefixes_meet_under_every_order():
    draw = np.random.default_rng(1)
    frequent = ngram_jaccard.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    for _ in range(300):
        a = np.unique(draw.integers(0, 1 << 63, draw.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([draw.permutation(a)[: max(1, int(len(a) * draw.uniform(0.6, 1)))],
                                      draw.integers(0, 1 << 63, draw.integers(0, 8), dtype=np.uint64)]))
        if ngram_jaccard.linked(a, b):
            names = np.sort(draw.permutation(a)[: len(a) // 2])
            for f in (frequent, ngram_jaccard.Frequent(names, draw.integers(1, 9, len(names)))):
                for order in range(ngram_jaccard.ORDERS):
                    both = np.intersect1d(ngram_jaccard.prefix(a, f, order), ngram_jaccard.prefix(b, f, order))
                    assert len(both) >= ngram_jaccard.common(min(len(a), len(b)))


def test_tokens_are_those_of_plain_shingles():
    """Equal shingles, and only those, have equal tokens, in whatever text and place they stand."""
    import pyarrow as pa
    from llm_helpers import shingles
    draw = random.Random(4)
    words = ["a", "A", "b", "ab", "AB", "ba", "Ä", "ä", "é", "long" * 90, "中文", "x\x00y", "\x1cz", "word."]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 2, 4, 5, 6, 30]))) for _ in range(400)]
    texts += [None, "", "  \t\n", "one", " one\x0btwo ", "a\rb\x0cc d e", "w " * 100_000]
    sets = ngram_jaccard.token_sets(pa.array(texts))
    meaning = {}
    for text, got in zip(texts, sets):
        plain = shingles(text)
        assert len(got) == len(plain) and (np.diff(got.astype(object)) > 0).all()
        meaning.setdefault(frozenset(plain), set()).add(got.tobytes())
        assert ngram_jaccard.token_set(text).tobytes() == got.tobytes()
    assert all(len(v) == 1 for v in meaning.values()) and len({x for v in meaning.values() for x in v}) == len(meaning)


def test_large_buckets_of_loose_copies(spark):
    """Copies so far apart that only some of them link, in buckets too large to join."""
    draw = random.Random(21)
    texts = []
    for size, edits, n in ((100, 9, 130), (60, 5, 90), (140, 12, 60)):
        base = [f"b{size}x{i}" for i in range(size)]
        for k in range(n):
            words = list(base[: size - draw.randrange(10)])
            for e in range(draw.randint(0, edits) // 3 + draw.choice([0, 0, 1])):
                words[draw.randrange(len(words))] = f"own{size}x{k}x{e}"
            texts.append(" ".join(words))
    want = jaccard_groups(dict(enumerate(texts)))
    assert 3 < len({c for _, c in want.values()}) < len(texts) - 20
    got = {r["id"]: (r["n"], r["component"]) for r in ngram_jaccard.groups(docs_of(spark, texts)).collect()}
    assert got == want
