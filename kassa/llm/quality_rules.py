"""Quality rules with host verdicts.

Every text is measured (words, symbols, repeated lines, repeated three-word windows) and fails
when it is too short or mostly repetition.  Failures are then counted per host, each host's
failure rate is shrunk towards the corpus by a beta prior fitted to all hosts' rates (method of
moments), and documents of a host whose shrunk rate passes a limit go as well.

Defined results: a null text has no words (and so fails); a null host is a host of its own; the
host table of an empty input is empty; repeated rows count as often as they occur; a single host,
or hosts with equal rates, give an infinitely strong prior, which is the mean rate itself.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.common import SPACES, Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 3
SALTS = 16
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: a host whose shrunk failure rate is above this loses all its documents
    max_host_rate: float = 0.5


def repeated_words(words: list) -> int:
    """Words inside a three-word window that occurs at least twice, each word counted once."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = ids[: n - WINDOW + 1]
    for shift in range(1, WINDOW):
        # renumbered after each word, so the keys never outgrow 64 bits
        key = key * len(number) + ids[shift: n - WINDOW + 1 + shift]
        _, key = np.unique(key, return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(n, bool)
    for shift in range(WINDOW):
        covered[shift: n - WINDOW + 1 + shift] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts],
                        columns=MEASURES, dtype="int64")


def failed(m, limits: Limits):
    """The rule over a struct of measures."""
    return (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_pct * m["n_words"])


def _host_key(host):
    return F.when(host.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), host.cast("string")))


def host_rates(scratch: Scratch, measured: DataFrame) -> DataFrame:
    """(host_key, n, n_failed, shrunk_rate) from rows of (host_key, base_failed)."""
    hosts = scratch.settle(measured.groupBy("host_key").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread")).first()  # two numbers
    if prior.spread:
        strength = max(prior.mean * (1 - prior.mean) / prior.spread - 1, 0.0)
        shrunk = (F.col("n_failed") + prior.mean * strength) / (F.col("n") + strength)
    else:
        shrunk = F.lit(prior.mean).cast("double")
    return hosts.withColumn("shrunk_rate", shrunk)


def judge(scratch: Scratch, docs: DataFrame, text: str, host: str, keep: list[str], limits: Limits = Limits(),
          reuse: bool = True) -> DataFrame:
    """``keep`` columns as struct ``row``, struct ``m`` of measures, ``base_failed`` and ``kept``.

    With ``reuse`` the measured rows are written once and read twice, which suits a few narrow
    columns; without it texts are measured twice and never written or shuffled.
    """
    measured = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"), _host_key(docs[host]).alias("host_key"),
        measure(docs[text]).alias("m"))
    measured = measured.withColumn("base_failed", failed(F.col("m"), limits))
    if reuse:
        measured = scratch.settle(measured, "measured")
    # written, so the planner knows its true size and decides between broadcast and shuffle
    bad = scratch.settle(
        host_rates(scratch, measured.select("host_key", "base_failed"))
        .where(F.col("shrunk_rate") > limits.max_host_rate)
        .select(F.col("host_key").alias("bad_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")),
        "bad_hosts")
    # salted: one host may hold a third of all rows
    measured = measured.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    out = measured.join(bad, (F.col("host_key") == F.col("bad_host")) & (F.col("_salt") == F.col("salt")), "left")
    return out.select("row", "m", "base_failed",
                      (~F.col("base_failed") & F.col("bad_host").isNull()).alias("kept"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their own columns."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    out = judge(scratch, docs, text, host, docs.columns, limits, reuse=False)
    return out.where("kept").select("row.*")
