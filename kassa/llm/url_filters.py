"""URL rules by a sort-merge range join.

A host's labels are reversed ("www.example.com" -> com, example, www), so a rule for a host and
all its subdomains is the interval of keys that begin with the rule's key.  URLs are range-sorted
by that key; every range partition gets the rules whose interval reaches into it, and one sorted
sweep keeps a stack of the rules whose interval is open.  Rules of one host sit on one level of
the stack, looked up by path length, so many path rules on one host stay cheap.

The longest fitting rule (host plus path) wins, then the longer host.  Without a fitting rule
the verdict is ``default``.  Defined results: a null URL or one without "://" has an empty host
and path and gets ``default``; repeated rows are judged each; equal rules with different verdicts:
block wins; an empty rule table leaves every URL at ``default``.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import Scratch, lower_ascii

#: closes each label of a key
END = "\x01"


def host_and_path(url):
    """(host, path) columns of a URL column."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(raw), path


def reversed_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, rules first): judges URLs against the open rules."""
    part, stack = None, []  # levels: (key, host length, {path: (rule, verdict)}, lengths of paths)
    for batch in batches:
        keep, rules, verdicts = [], [], []
        for i, (p, key, kind, host, path, verdict) in enumerate(
                zip(batch["part"], batch["key"], batch["kind"], batch["host"], batch["path"], batch["verdict"])):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, len(host), {}, []))
                paths, lengths = stack[-1][2:]
                if paths.get(path, ("", ""))[1] != "block":
                    paths[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = (-1, -1, None, default)
            for _, host_length, paths, lengths in stack:
                for n in lengths:
                    hit = paths.get(path[:n]) if n <= len(path) else None
                    if hit:
                        best = max(best, (host_length + n, host_length, *hit), key=lambda x: x[:2])
                        break
            keep.append(i)
            rules.append(best[2])
            verdicts.append(best[3])
        out = batch.iloc[keep].drop(columns=["key", "kind", "verdict"])
        yield out.assign(rule=pd.Series(rules, index=out.index, dtype=object), verdict=verdicts)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """(``key``, host, path, rule, verdict) for every page; ``rules``: host, path, verdict."""
    scratch = Scratch(pages.sparkSession, "url-filters")
    host, path = host_and_path(pages[url])
    # as text: a nullable number would pass through the sweep as a float
    urls = pages.select(pages[key].cast("string").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    # the path and a hash of the row split a host that holds a large part of all rows
    order = ["key", "path", F.xxhash64("id", "path")]
    urls = scratch.settle(
        urls.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "urls")
    # one row per range partition
    spans = urls.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    if spans:
        reach = F.array(*[F.struct(F.lit(s["part"]).alias("part"), F.lit(s["low"]).alias("low"),
                                   F.lit(s["high"]).alias("high")) for s in spans])
        rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                             F.col("verdict").alias("verdict")).distinct()
        rules = rules.withColumn("key", reversed_key(lower_ascii(F.col("host"))))
        begin = F.col("key")
        # a rule reaches a partition unless all keys there end before it or begin after its interval
        rules = rules.withColumn("part", F.explode(F.transform(
            F.filter(reach, lambda s: (s["high"] >= begin) & ((s["low"] <= begin) | s["low"].startswith(begin))),
            lambda s: s["part"])))
    else:
        rules = rules.select("host", "path", "verdict").limit(0).withColumns({"key": F.lit(""), "part": F.lit(0)})
    columns = ["part", "key", "kind", "id", "host", "path", "verdict"]
    rows = urls.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")}).select(columns).unionByName(
        rules.withColumns({"kind": F.lit(0), "id": F.lit(None).cast("string")}).select(columns))
    judged = (rows.repartition("part").sortWithinPartitions("part", "key", "kind")
              .mapInPandas(lambda batches: sweep(batches, default),
                           "part int, id string, host string, path string, rule string, verdict string"))
    return judged.select(F.col("id").cast(pages.schema[key].dataType).alias(key), "host", "path", "rule", "verdict")
