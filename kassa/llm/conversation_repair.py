"""Repair of conversation structure by Viterbi with survivor coalescence.

A conversation's rows, in order, must end up with role initials ``(s?(ua)+)?``.  A row may be kept (0), given the
role user or assistant (2) or deleted (3, required where it is blank or a duplicate); empty rows of user or
assistant may be inserted anywhere (2 each); a truncated row that stays costs 1.  The cheapest edits win, and
among those the ones whose initials (K, R, D, I) come first in ASCII order.

The states are what has been put out so far: nothing, a system row, a user row, an assistant row.  Rows stream
through; every state keeps one survivor, a leaf in a tree of backpointers, unless another state could go on in
its place for strictly less.  A leaf without a successor is
removed, and so is every node whose count of children falls to zero; once the root has a single child, all
survivors agree on it, its edits are emitted and it becomes the root.  Memory is the tree between the oldest
open decision and the current row, without texts.

Ties are decided on the complete edits since the common ancestor.  Insertions are made before a row or at the
end, so at a row's end every survivor's edits end with that row's letter and none is a beginning of another:
their order stays what it is whatever follows.  It is carried along as ranks and equals a comparison
of the complete suffixes.

Two streams over rows of one conversation: the first decides edits from narrow rows (role initial, fault), the
second applies them to the texts and hashes the result, holding neither.  A conversation's rows pass through one
task, as its digest is one chain; whether a row repeats an earlier one is found before, by an
aggregate per role and text and a join on row ids, so no set of texts grows with a conversation.

Defined results: a null role or text is one space; a null conversation is a conversation; rows of one turn are
ordered by role, then by the text's md5 (null turns first); a row without an initial (empty role) fits nowhere and
is given a role or deleted; repeated rows are duplicates; a conversation without rows has zeros, no edits and the
digest of the empty string; an empty table gives an empty result.  Only the four named columns are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import SPACES, Scratch, global_order

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
#: faults of a row, by their number
FINE, BLANK, DUPLICATE, CUT = range(4)
#: sorts behind every row
END = (1 << 63) - 1


def _after(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _insertions(state: int) -> list[tuple[int, str]]:
    """Useful insertions from a state: (state after, initials); a way round to the same state never pays."""
    out, at = [(state, "")], state
    for _ in range(2):
        initial = "a" if at == USER else "u"
        at = _after(at, initial)
        if at in [s for s, _ in out]:
            break
        out.append((at, out[-1][1] + initial))
    return out


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, str, str]]]:
    """Per state the (state after, cost, letters, initials made) of every way to pass one row."""
    out = []
    for state in range(4):
        ways = []
        for at, made in _insertions(state):
            cost, letters = INSERT * len(made), "I" * len(made)
            ways.append((at, cost + DELETE, letters + "D", made))
            if fault in (BLANK, DUPLICATE):
                continue
            extra = TRUNCATED if fault == CUT else 0
            if (kept := _after(at, initial)) is not None:
                ways.append((kept, cost + KEEP + extra, letters + "K", made))
            new = "a" if at == USER else "u"
            ways.append((_after(at, new), cost + REROLE + extra, letters + "R", made + new))
        out.append(ways)
    return out


MOVES = {(i, f): _moves(i, f) for i, f in product(("s", "u", "a", ""), range(4))}
#: insertions that end a conversation rightly, per state
CLOSING = [[(at, INSERT * len(made), "I" * len(made), made) for at, made in _insertions(s) if at in (NOTHING, ASSISTANT)]
           for s in range(4)]

#: the most it can cost to go on from a state (row) as another one (column) would: insert its way there, or
#: delete the system row that only the empty beginning may keep
INSTEAD = [[0, 0, 2, 0],
           [4, 0, 2, 4],
           [5, 2, 0, 2],
           [3, 0, 2, 0]]


class Node:
    """Edits of one row on some survivor's way; ``children`` counts and holds the nodes that build on it."""
    __slots__ = ("parent", "row", "letters", "made", "children")

    def __init__(self, parent, row, letters, made):
        self.parent, self.row, self.letters, self.made, self.children = parent, row, letters, made, []


class Repairer:
    """The edits of one conversation: feed rows with ``step``, then ``close``; both return settled
    (row, letters, made), in order.  ``open_nodes`` is the size of the tree."""

    def __init__(self):
        self.root = Node(None, None, "", "")
        self.survivors = {NOTHING: (0, 0, self.root)}  # state: (cost, rank, leaf)
        self.open_nodes = 0

    def _advance(self, row, moves) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, rank, leaf) in self.survivors.items():
            for after, price, letters, made in moves[state]:
                way = (cost + price, rank, letters, made, leaf)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        leaves = [leaf for _, _, leaf in self.survivors.values()]
        # a state whose way another one can go on for less is no survivor: it can neither win nor tie
        best = {s: way for s, way in best.items() if all(way[0] <= other[0] + INSTEAD[t][s] for t, other in best.items())}
        rank = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        self.survivors = {}
        for state, (cost, _, letters, made, parent) in best.items():
            node = Node(parent, row, letters, made)
            parent.children.append(node)
            self.open_nodes += 1
            self.survivors[state] = (cost, rank[state], node)
        for leaf in leaves:
            while not leaf.children and leaf is not self.root:
                leaf.parent.children.remove(leaf)
                self.open_nodes -= 1
                leaf = leaf.parent

    def _settled(self) -> Iterator[tuple]:
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.open_nodes -= 1
            yield self.root.row, self.root.letters, self.root.made

    def step(self, row, initial: str, fault: int) -> Iterator[tuple]:
        self._advance(row, MOVES[initial if initial in ("s", "u", "a") else "", fault])
        return self._settled()

    def close(self) -> tuple[int, list[tuple]]:
        """(cost, the last settled edits); the closing insertions have the row ``END``."""
        self._advance(END, CLOSING)
        # either end is fine: only the cheapest stays
        cost, _, leaf = min(self.survivors.values(), key=lambda x: x[:2])
        way = []
        while leaf is not self.root:
            way.append((leaf.row, leaf.letters, leaf.made))
            leaf = leaf.parent
        return cost, way[::-1]


def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (conv, uid): their edits, and one row per conversation with its counts."""
    conv, now, seen = None, None, False
    out: list[tuple] = []

    def finish():
        cost, last = now.close()
        edits(last)
        gaps = stats["max"] - stats["min"] + 1 - stats["turns"] if stats["turns"] else 0
        out.append((conv, END, "", "", gaps, *stats["faults"][1:], stats["illegal"], cost))

    def edits(settled):
        out.extend((conv, row, letters, made, None, None, None, None, None, None) for row, letters, made in settled)

    for batch in batches:
        for c, uid, turn, initial, fault in zip(batch["conv"], batch["uid"], batch["turn"], batch["initial"], batch["fault"]):
            if not seen or c != conv:
                if seen:
                    finish()
                conv, now, seen = c, Repairer(), True
                stats = {"faults": [0] * 4, "illegal": 0, "turns": 0, "min": 0, "max": 0}
                before = None
            stats["faults"][fault] += 1
            if before is not None and before + initial not in ("su", "ua", "au"):
                stats["illegal"] += 1
            before = initial
            if turn is not None:
                turn = int(turn)
                if not stats["turns"]:
                    stats["min"] = turn
                if not stats["turns"] or turn != stats["max"]:
                    stats["turns"] += 1
                stats["max"] = turn
            edits(now.step(uid, initial, fault))
        yield pd.DataFrame(out, columns=_DECIDED_COLUMNS)
        out = []
    if seen:
        finish()
        yield pd.DataFrame(out, columns=_DECIDED_COLUMNS)


_DECIDED = ("conv string, uid long, letters string, made string, gaps long, blank long, duplicate long, "
            "truncated long, illegal long, cost long")
_DECIDED_COLUMNS = [c.split()[0] for c in _DECIDED.split(", ")]


def applied(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows sorted by (conv, uid, kind), edits (0) before the row (1) they belong to: (conv, letters, [(role, text)])."""
    letters = made = ""
    for batch in batches:
        for conv, uid, kind, a, b in zip(batch["conv"], batch["uid"], batch["kind"], batch["a"], batch["b"]):
            if kind == 0:
                letters, made = a, b
                if uid != END:
                    continue
            role, text = (None, None) if kind == 0 else (a, b)
            put = [(ROLE[x], "") for x in made[: letters.count("I")]]
            if letters.endswith("K"):
                put.append((role, text))
            elif letters.endswith("R"):
                put.append((ROLE[made[-1]], text))
            yield conv, letters, put


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, chain, n, audit, seen = None, None, 0, [], False
    done: list[tuple] = []
    for c, letters, put in applied(batches):
        if not seen or c != conv:
            if seen:
                done.append((conv, "".join(audit), chain.hexdigest(), n))
            conv, chain, n, audit, seen = c, hashlib.sha256(), 0, [], True
        audit.append(letters)
        for role, text in put:
            chain.update((("\n" if n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            n += 1
        if len(done) >= 1000:
            yield pd.DataFrame(done, columns=["conv", "audit", "sha", "n"])
            done = []
    if seen:
        done.append((conv, "".join(audit), chain.hexdigest(), n))
    yield pd.DataFrame(done, columns=["conv", "audit", "sha", "n"])


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, n, seen, held = None, 0, False, []
    for c, _, put in applied(batches):
        if not seen or c != conv:
            conv, n, seen = c, 0, True
        for role, text in put:
            held.append((c, n, role, text))
            n += 1
        if len(held) >= 1000:
            yield pd.DataFrame(held, columns=["conv", "place", "role", "text"])
            held = []
    yield pd.DataFrame(held, columns=["conv", "place", "role", "text"])


class Repair:
    """Edits decided for a table of rows; ``report`` and ``rows`` apply them."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.scratch = scratch = Scratch(rows.sparkSession, "conversation-repair")
        self.type = rows.schema[conv].dataType
        spoken = rows.select(rows[conv].cast("string").alias("conv"), rows[turn].cast("long").alias("turn"),
                             F.coalesce(rows[role], F.lit(" ")).alias("role"), F.coalesce(rows[text], F.lit(" ")).alias("text"))
        spoken = spoken.withColumn("mark", F.md5(F.col("text").cast("binary")))
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark"]
        self.spoken = global_order(scratch, spoken, order, "rows")
        first = self.spoken.groupBy("conv", "role", "mark").agg(F.min("_uid").alias("first")).select("first")
        ending = F.rtrim(F.col("text"), F.lit(SPACES))
        narrow = self.spoken.select("conv", F.col("_uid").alias("uid"), F.col("turn").cast("string").alias("turn"),
                                    F.substring("role", 1, 1).alias("initial"), (ending == "").alias("blank"),
                                    F.substring(ending, -1, 1).isin(".", "!", "?").alias("ended"))
        narrow = narrow.join(first, F.col("uid") == F.col("first"), "left")
        fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE)
                 .when(~F.col("ended"), CUT).otherwise(FINE))
        narrow = narrow.select("conv", "uid", "turn", "initial", fault.alias("fault"))
        narrow = narrow.repartition("conv").sortWithinPartitions("conv", "uid")
        self.decided = scratch.settle(narrow.mapInPandas(decide, _DECIDED), "edits")

    def _paired(self) -> DataFrame:
        edits = self.decided.where("cost IS NULL").select(
            "conv", "uid", F.lit(0).alias("kind"), F.col("letters").alias("a"), F.col("made").alias("b"))
        rows = self.spoken.select("conv", F.col("_uid").alias("uid"), F.lit(1).alias("kind"),
                                  F.col("role").alias("a"), F.col("text").alias("b"))
        return edits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "uid", "kind")

    def rows(self) -> DataFrame:
        """The repaired rows: conv, place (from 0), role, text."""
        out = self._paired().mapInPandas(_repaired, "conv string, place long, role string, text string")
        return out.withColumn("conv", F.col("conv").cast(self.type))

    def report(self, conversations: DataFrame) -> DataFrame:
        """One row for each of ``conversations`` (one column): counts, cost, audit, digest of the repaired rows."""
        digests = self._paired().mapInPandas(_digests, "conv string, audit string, sha string, n long")
        counts = self.decided.where("cost IS NOT NULL").drop("uid", "letters", "made").withColumnRenamed("conv", "c")
        found = digests.join(counts, F.col("conv").eqNullSafe(F.col("c")))
        every = conversations.select(F.col(conversations.columns[0]).alias("id")).distinct()
        out = every.join(found, F.col("id").cast("string").eqNullSafe(F.col("conv")), "left")
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                          F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults to repair, chosen by the row's crc32: 0 drops it, 1 empties its text, 2 removes its sentence ends,
    3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    mark = F.concat(F.coalesce(rows[conv].cast("string"), space), F.lit(":"), F.coalesce(rows[turn].cast("string"), space))
    out = rows.select(rows[conv].alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role], space).alias("role"),
                      F.coalesce(rows[text], space).alias("text"), (F.crc32(mark.cast("binary")) % 20).alias("fault"))
    out = out.where("fault != 0").withColumns({
        "text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))})
    return out.drop("fault", "copy")
