"""Reply trees to training conversations.

Messages point to their parent.  Pointer doubling (self-joins, one per power of two of the
depth) gives every message its root, depth and summed score; each tree's leaves are ranked by
mean score, then depth, then id; the chosen leaves' ancestors are found by the same pointers, and
each chosen root-to-leaf path becomes one formatted text with the spans a loss should cover.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line break becomes ``\\n``.  So no text
can forge a mark, and ``parse`` reads back exactly what went in.

Defined results: a null text, role or score is empty, empty or 0; a parent that does not exist
makes its child a root; messages in a parent cycle reach no root and are left out; repeated rows
are separate messages as long as their ids differ; an empty table gives no conversations.
"""
from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.common import Scratch, global_order, with_next

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(a, role=True), unescape(b)) for a, b in _TURN.findall(formatted)]


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the (start, length) spans of the trained role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, role=True)}\n", escape(text)
        if role == trained:
            spans.append((at + len(head), len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_DIGEST = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(),
           "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}


@F.pandas_udf(T.StructType([T.StructField("formatted", T.StringType()), T.StructField("spans", _SPANS)]))
def render_path(paths: pd.Series) -> pd.DataFrame:
    done = [render([(t["role"], t["text"]) for t in turns]) for turns in paths]
    return pd.DataFrame({"formatted": [f for f, _ in done],
                         "spans": [[{"start": a, "length": n} for a, n in s] for _, s in done]})


@F.pandas_udf(T.StructType([T.StructField(c, t) for c, t in _DIGEST.items()]))
def read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Digests of what a reader of the formatted text and its spans gets."""
    out = []
    for text, marks in zip(formatted, spans):
        turns = parse(text)
        loss = "".join(unescape(text[s["start"]: s["start"] + s["length"]]) for s in marks)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
    return pd.DataFrame(out, columns=list(_DIGEST))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def chosen_paths(scratch: Scratch, links: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, id, depth) of every message on a chosen path.

    ``links``: tree, id, parent, score, where ids are unique over all trees.
    """
    # jump j: the ancestor 2^j above, with score and depth summed from the message up to below it.
    # Messages that have reached their root are done and not joined again.
    known = links.select(F.col("id").alias("known"))
    hops = scratch.settle(
        links.join(known, links["parent"] == known["known"], "left")
        .select("tree", "id", F.col("known").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"),
                F.lit(1).cast("long").alias("depth")), "jump0")
    above, done = F.col("up").isNotNull(), hops.where(F.col("up").isNull())
    jumps, n = [hops.where(above)], hops.count()
    while not jumps[-1].isEmpty():
        if 2 ** (len(jumps) - 1) > n:  # longer than any tree: only cycles still point upwards
            break
        low = jumps[-1]
        high = done.unionByName(low).select(
            F.col("id").alias("mid"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        further = scratch.settle(low.join(high, low["up"] == high["mid"]).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"),
            (F.col("depth") + F.col("d2")).alias("depth")), f"jump{len(jumps)}")
        done = done.unionByName(further.where(F.col("up").isNull()))
        jumps.append(further.where(above))
    rooted = done.select("tree", "id", "total", "depth")
    parents = hops.where(F.col("up").isNotNull()).select(F.col("up").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["id"] == parents["p"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id")
    best = (leaves.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= branches)
            .select("tree", F.col("id").alias("leaf"), "id", "depth"))
    path = scratch.settle(best, "leaves")
    # a distance is one sum of powers of two, so every ancestor is reached exactly once
    for j in range(len(jumps) - 1, -1, -1):
        hop = jumps[j].select(F.col("id").alias("from"), F.col("up").alias("to"))
        more = path.join(hop, path["id"] == hop["from"]).select(
            "tree", "leaf", F.col("to").alias("id"), (F.col("depth") - 2 ** j).alias("depth"))
        path = scratch.settle(path.unionByName(more), f"path{j}")
    return path


def format_trees(messages: DataFrame, tree: str, id: str, parent: str, role: str, text: str,
                 score: str | None = None, branches: int = 1) -> DataFrame:
    """(tree, leaf, formatted, spans): one row per chosen path."""
    scratch = Scratch(messages.sparkSession, "chat-format")
    m = messages.select(
        messages[tree].alias("tree"), messages[id].alias("id"), messages[parent].alias("parent"),
        F.coalesce(messages[role], F.lit("")).alias("role"), F.coalesce(messages[text], F.lit("")).alias("text"),
        (messages[score] if score else F.lit(0.0)).cast("double").alias("score"))
    path = chosen_paths(scratch, m.select("tree", "id", "parent", "score"), branches)
    said = m.select(F.col("id").alias("said_id"), "role", "text")
    turns = path.join(said, path["id"] == said["said_id"]).groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    out = turns.withColumn("out", render_path(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    return out.select("tree", "leaf", "out.formatted", "out.spans")


def conversations_as_trees(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                           role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: each row answers the one before it.

    Rows of a conversation follow ``turn`` (nulls first); equal turns keep a fixed order by
    role and text.  A null conversation id is a conversation of its own.
    """
    scratch = Scratch(conversations.sparkSession, "chat-trees")
    rows = conversations.select(conversations[conv].alias("conv"), conversations[turn].alias("turn"),
                                conversations[role].alias("role"), conversations[text].alias("text"))
    order = ["conv", "turn", F.xxhash64("role", "text")]
    rows = global_order(scratch, rows, order, "rows")
    before = with_next(rows, ["conv", "_uid"], offset=-1)
    same = F.col("_next").isNotNull() & F.col("conv").eqNullSafe(F.col("_next.conv"))
    return before.select("conv", F.col("_uid").alias("id"),
                         F.when(same, F.col("_next._uid")).alias("parent"), "role", "text")
