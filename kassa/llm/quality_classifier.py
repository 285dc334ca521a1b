"""Quality classifier: random-indexing word vectors, pooled per text, and a small neural network.

Every word has a sparse random index vector (a few +1 and -1 at places its hash chooses).  Words that
come up often enough in the training sample also get a context vector, the sum of their neighbours'
index vectors there; a word's vector is the two normalised parts side by side in one space.  A text is the
mean of its words' vectors.  A two-layer network (numpy, Adam) turns that into a score; a
temperature fitted on rows the network has not seen calibrates it to a probability.

Learning sees at most ``SAMPLE`` labelled rows of the given documents (those with the least key hashes) and
``SAMPLE_BYTES`` of text, and runs in a task; the model that travels to the tasks is at most ``VOCABULARY`` words plus ``BUCKETS`` hashed
rows.  Scoring runs over whole texts and needs nothing but the text.

Because the first layer is linear in the mean, each word's share of every hidden unit is computed once;
a text's hidden layer is the mean of its words' rows.

Defined results: null and empty texts have no words and score as the zero vector; a word is a run of
letters and digits or of other visible characters, in lower case, and one in capitals only counts as a
capitals mark too, one equal to the word before it as a repetition mark; labels other than 0 and 1 are ignored, several labels of a document are averaged;
without both classes among the labels every score is the mean label (0.5 without any); repeated rows are scored
each, and each counts if it is learned from; an empty table has no rows; the caller's columns travel in the
struct ``row``, whatever their names.
"""
from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.common import give_back_memory

#: most labelled rows that are learned from, most words with a context vector, hashed rows for all others
SAMPLE, VOCABULARY, BUCKETS = 6000, 40_000, 1 << 15
#: most bytes of text that are learned from
SAMPLE_BYTES = 32 << 20
DIMENSIONS, NONZERO, NEIGHBOURS, HIDDEN, EPOCHS, SEED = 128, 8, 2, 32, 40, 7
THRESHOLD = 0.3
#: words handled at once while learning
STRETCH = 20_000
_WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
CAPITALS, AGAIN = "\x01capitals", "\x01again"


def words_in(text: str | None) -> list[str]:
    out = _WORD.findall(text) if text else []
    capitals = [CAPITALS for w in out if len(w) > 1 and w.isupper()]
    out = [w.lower() for w in out]
    return out + capitals + [AGAIN for a, b in zip(out, out[1:]) if a == b]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def index_vectors() -> np.ndarray:
    """The random index vectors of all hash buckets, of length 1."""
    draw = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = draw.integers(0, DIMENSIONS, (BUCKETS, NONZERO))
    signs = draw.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


class _Rows(dict):
    """Word -> row of the table: its own if it is in the vocabulary, else its hash bucket's."""

    def __init__(self, vocabulary: list[str]):
        super().__init__((w, BUCKETS + i) for i, w in enumerate(vocabulary))

    def __missing__(self, word: str) -> int:
        return _bucket(word)


@dataclass
class Model:
    vocabulary: list[str]
    #: per row of the table its share of the hidden units
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float
    constant: float | None = None

    def scores(self, texts, rows: _Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        hidden = np.zeros((len(texts), HIDDEN), np.float32)
        for i, text in enumerate(texts):
            ids = list(map(rows.__getitem__, words_in(text)))
            if ids:
                hidden[i] = self.table[ids].mean(axis=0, dtype=np.float64)
        # summed row by row: a matrix product's order of summing depends on the place in the batch
        logit = np.ascontiguousarray(np.tanh(hidden + self.bias) * self.out).sum(axis=1) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -50, 50)))


def _context_vectors(sequences: list[np.ndarray], index: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors per row; ``bucket`` maps rows to hash buckets."""
    out = np.zeros((len(bucket), DIMENSIONS), np.float32)

    def add(rows, neighbours):
        order = np.argsort(rows, kind="stable")
        row = rows[order]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[begin]] += np.add.reduceat(index[bucket[neighbours[order]]], begin, axis=0)

    # a bounded stretch of words at a time
    for near in range(1, NEIGHBOURS + 1):
        held, size = [], 0
        for i, s in enumerate(sequences):
            for at in range(0, len(s) - near, STRETCH):
                held.append((s[at: at + STRETCH][: len(s) - near - at], s[at + near: at + near + STRETCH]))
                size += len(held[-1][0])
            if held and (size >= STRETCH or i == len(sequences) - 1):
                left, right = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                add(left, right)
                add(right, left)
                held, size = [], 0
    return out


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Learns from texts and labels 0/1, with no outside randomness."""
    if len(set(labels.tolist())) < 2:
        constant = float(labels.mean()) if len(labels) else 0.5
        nothing = np.zeros((0, HIDDEN), np.float32)
        return Model([], nothing, nothing, nothing, 0.0, 1.0, constant)
    index = index_vectors()
    # texts are split twice, so that their words are never all in memory
    counts: dict[str, int] = {}
    for text in texts:
        for w in words_in(text):
            counts[w] = counts.get(w, 0) + 1
    vocabulary = [w for _, w in sorted((-n, w) for w, n in counts.items() if n > 1)[:VOCABULARY]]
    del counts
    rows = _Rows(vocabulary)
    bucket = np.concatenate([np.arange(BUCKETS), [_bucket(w) for w in vocabulary]]).astype(np.int64)
    sequences = [np.array(list(map(rows.__getitem__, words_in(text))), np.int32) for text in texts]
    context = _context_vectors(sequences, index, bucket)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    context[:BUCKETS] = 0  # a shared bucket's neighbours say nothing of one word
    vectors = index[bucket] + context
    x = np.stack([sum((vectors[s[i: i + STRETCH]].sum(axis=0, dtype=np.float64) for i in range(0, len(s), STRETCH)),
                      np.zeros(DIMENSIONS)) / max(len(s), 1) for s in sequences])
    spread = x.std(axis=0) + 1e-6
    middle = x.mean(axis=0)
    x = (x - middle) / spread

    draw = np.random.default_rng(SEED)
    order = draw.permutation(len(x))
    check, train = order[: len(x) // 5], order[len(x) // 5:]
    y = labels.astype(np.float64)
    p = [draw.normal(0, DIMENSIONS ** -0.5, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in range(0, len(train), 64):
            rows_ = train[draw.integers(0, len(train), 64)]
            h = np.tanh(x[rows_] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -50, 50))) - y[rows_]) / len(rows_)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[rows_].T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    logit = np.tanh(x[check] @ p[0] + p[1]) @ p[2] + p[3][0]

    def loss(temperature: float) -> float:
        z = logit / temperature
        return float(np.mean(np.logaddexp(0, z) - y[check] * z))

    temperature = min(np.geomspace(0.25, 8, 61), key=loss) if len(check) else 1.0
    inner = p[0] / spread[:, None]
    return Model(vocabulary, vectors @ inner.astype(np.float32), (p[1] - middle @ inner).astype(np.float64),
                 p[2], float(p[3][0]), float(temperature))


def held_out(key):
    """Rows that are never learned from: the key's crc32 is divisible by five (or the key is null)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(t, y): the texts that are learned from, in the order of their keys' hashes: of the documents with a label
    the first ``SAMPLE`` whose texts have at most ``SAMPLE_BYTES`` together (none of more than a sixteenth of that)."""
    known = labels.where(labels[label].isin(0, 1) & ~held_out(labels[key])).groupBy(labels[key].alias("lk")).agg(
        (F.avg(labels[label]) >= 0.5).cast("int").alias("y"))
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    sizes = docs.select(docs[key].alias("k"), size.alias("size")).where(F.col("size") <= SAMPLE_BYTES // 16)
    order = [F.xxhash64("lk"), F.col("lk"), F.col("size")]
    chosen = sizes.join(known, F.col("k") == F.col("lk")).orderBy(*order).limit(SAMPLE)
    # at most SAMPLE rows in this window, and on the broadcast side below
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("total", total).where(F.col("total") <= SAMPLE_BYTES).select("lk", "y").distinct()
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), size.alias("size")).where(F.col("size") <= SAMPLE_BYTES // 16)
    rows = rows.join(F.broadcast(chosen), F.col("k") == F.col("lk")).withColumn("mark", F.xxhash64("t"))
    return rows.orderBy(F.xxhash64("k"), "k", "mark").limit(SAMPLE).select("t", "y")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model, learned from the bounded sample in one task; only the model comes to the driver."""
    def learn(batches):
        texts, y = [], []
        for b in batches:
            texts += b["t"].tolist()
            y += b["y"].tolist()
        model = pickle.dumps(fit(texts, np.array(y, np.int64)))
        texts.clear()
        give_back_memory()
        yield pd.DataFrame({"model": [model]})

    learned = sample(docs, labels, key, text, label).coalesce(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else fit([], np.zeros(0, np.int64))


def scorer(docs: DataFrame, model: Model):
    """Column function: text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        rows = m.__dict__.get("_rows") or m.__dict__.setdefault("_rows", _Rows(m.vocabulary))
        for texts in batches:
            yield pd.Series(m.scores(texts.tolist(), rows), dtype="float64")
        give_back_memory()
    return score


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Struct ``row`` (the caller's columns), ``held_out``, ``score``, ``predicted``."""
    score = scorer(docs, train(docs, labels, key, text))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), held_out(docs[key]).alias("held_out"),
                      score(docs[text]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are predicted to be good, with their own columns."""
    return classify(docs, labels, key, text).where("predicted = 1").select("row.*")
