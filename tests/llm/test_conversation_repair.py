import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from kassa.llm import conversation_repair as cr

RIGHT = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit, repaired) by trying every edit; rows: (role, text, fault)."""
    ways = []
    for gaps in product(range(3), repeat=len(rows) + 1):
        for ops in product("KRD", repeat=len(rows)):
            cost, audit, count = 2 * sum(gaps), "", 0
            for g, op, (role, text, fault) in zip(gaps, ops, rows):
                audit += "I" * g + op
                cost += {"K": 0, "R": 2, "D": 3}[op] + (op != "D" and fault == cr.CUT)
                if op != "D" and fault in (cr.BLANK, cr.DUPLICATE):
                    cost = None
                    break
            if cost is not None:
                ways.append((cost, audit + "I" * gaps[-1]))
    for cost, audit in sorted(set(ways)):
        # roles of new and changed rows: whichever of the two makes it right
        it, slots = iter(rows), []
        for letter in audit:
            role, text, _ = (None, "", None) if letter == "I" else next(it)
            if letter != "D":
                slots.append(([role] if letter == "K" else ["user", "assistant"], text))
        for roles in product(*[r for r, _ in slots]):
            initials = [r[:1] for r in roles]
            if all(initials) and RIGHT.match("".join(initials)):
                return cost, audit, [(r, t) for r, (_, t) in zip(roles, slots)]
    raise AssertionError


def repair(rows):
    r, settled = cr.Repairer(), []
    for i, (role, _, fault) in enumerate(rows):
        settled += r.step(i, role[:1], fault)
    cost, last = r.close()
    settled += last
    audit, put, it = "", [], iter(rows)
    for row, letters, made in settled:
        audit += letters
        put += [(cr.ROLE[x], "") for x in made[: letters.count("I")]]
        if row != cr.END:
            role, text, _ = next(it)
            if letters[-1] == "K":
                put.append((role, text))
            elif letters[-1] == "R":
                put.append((cr.ROLE[made[-1]], text))
    return cost, audit, put


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_every_edit_tried(n):
    draw = random.Random(n)
    every = list(product(["system", "user", "assistant", "tool"], range(4)))
    cases = product(every, repeat=n) if n < 2 else [[draw.choice(every) for _ in range(n)] for _ in range(60 if n < 4 else 12)]
    for case in cases:
        rows = [(role, f"t{i}", fault) for i, (role, fault) in enumerate(case)]
        assert repair(rows) == brute(rows), rows


def whole_strings(rows):
    """The same by dynamic programming from the end with whole strings, which has no open ties."""
    states = "^sua"
    follow = {("^", "s"): "s", ("^", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    inf = 10 ** 9

    def inserted(best):
        for _ in range(3):
            for s in states:
                for made in "ua":
                    if (s, made) in follow:
                        c, a = best[follow[s, made]]
                        best[s] = min(best[s], (c + 2, "I" + a))
        return best

    best = inserted({"^": (0, ""), "s": (inf, ""), "u": (inf, ""), "a": (0, "")})
    for role, _, fault in reversed(rows):
        new = {}
        for s in states:
            ways = [(best[s][0] + 3, "D" + best[s][1])]
            if fault in (cr.FINE, cr.CUT):
                late = int(fault == cr.CUT)
                if (s, role[:1]) in follow:
                    c, a = best[follow[s, role[:1]]]
                    ways.append((c + late, "K" + a))
                for x in "ua":
                    if (s, x) in follow:
                        c, a = best[follow[s, x]]
                        ways.append((c + late + 2, "R" + a))
            new[s] = min(ways)
        best = inserted(new)
    return best["^"]


def test_long_conversations_with_open_ties():
    draw = random.Random(5)
    for weights in ([1, 1, 1, 1], [0, 1, 1, 0], [0, 0, 0, 1], [0, 1, 0, 8]):
        for _ in range(15):
            rows = [(draw.choices(["system", "user", "assistant", "tool"], weights)[0], "", draw.choice([0, 0, 0, 1, 2, 3]))
                    for _ in range(draw.randint(5, 80))]
            assert repair(rows)[:2] == whole_strings(rows)


def test_memory_is_the_open_part():
    r, largest, n = cr.Repairer(), 0, 0
    for i in range(20_000):
        n += sum(1 for _ in r.step(i, "ua"[i % 2] if i % 7 else "u", cr.FINE))
        largest = max(largest, r.open_nodes)
    assert largest < 100 and n > 19_900


def _report(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return {r["id"]: r for r in cr.Repair(df).report(df.select("conv_id")).collect()}


def test_edge_cases(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"),
            (2, 5, "user", "Hi."), (2, 5, "user", "Hi."), (2, None, "assistant", "cut off"), (2, 9, None, "x."),
            (3, None, None, None), (4, 0, "", "no initial."), (4, 1, "assistant", "Fine. \n\t "),
            (None, 0, "user", "Q?"), (None, 1, "assistant", "A."),
            (5, 0, "user", "word " * 200_000 + "."), (5, 1, "assistant", "ok.")]
    got = _report(spark, rows)
    assert set(got) == {1, 2, 3, 4, 5, None}

    def sha(*pairs):
        return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in pairs).encode()).hexdigest()
    assert got[1][1:] == (0, 0, 0, 0, 0, 0, "KK", sha(("user", "Hi."), ("assistant", "Yes!")))
    assert got[None]["audit"] == "KK" and got[5]["cost"] == 0
    assert got[2][1:5] == (3, 0, 1, 1) and got[2]["illegal"] == 2
    assert got[3][1:] == (0, 1, 0, 0, 0, 3, "D", sha())
    assert got[4]["audit"] == "RK" and got[4]["cost"] == 2
    assert got[4]["repaired_sha256"] == sha(("user", "no initial."), ("assistant", "Fine. \n\t "))


def test_rows_come_back_repaired(spark):
    draw = random.Random(9)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["One.", "Two", " ", f"n{t}!"]))
            for c in range(40) for t in range(draw.randint(1, 12))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("uid", "conv", "kind", "mark", "_uid", "fault", "a")})
    r = cr.Repair(df)
    out: dict = {}
    for x in sorted(r.rows().collect(), key=lambda x: (x["conv"], x["place"])):
        assert x["place"] == len(out.setdefault(x["conv"], []))
        out[x["conv"]].append((x["role"], x["text"]))
    for x in r.report(df.select("conv_id")).collect():
        mine = out.get(x["id"], [])
        assert RIGHT.match("".join(role[0] for role, _ in mine))
        assert x["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest()


def test_no_rows_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.Repair(none).report(none.select("conv_id")).count() == 0
    ids = spark.createDataFrame([(7,)], "conv_id long")
    got = cr.Repair(none).report(ids).collect()
    assert got[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.damage(none).count() == 0
