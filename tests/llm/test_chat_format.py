from hypothesis import given, settings
from hypothesis import strategies as st

from kassa.llm import chat_format

PIECE = st.lists(st.sampled_from(list("ab\\<|>\n n") + ["<|im_end|>", "<|im_start|>", "é", "\r"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECE, PIECE), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat_format.render(turns, trained="a")
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[s: s + n]) for s, n in spans] == [t for r, t in turns if r == "a"]


def test_best_branch_of_each_tree(spark):
    #      1 -> 2 -> 4 (best), 2 -> 5; 1 -> 3.  Tree 2: one message.  Tree 3: a cycle.
    rows = [("t1", 1, None, "user", "a", 0.0), ("t1", 2, 1, "assistant", "b", 1.0), ("t1", 3, 1, "assistant", "c", 0.2),
            ("t1", 4, 2, "user", "d", 3.0), ("t1", 5, 2, "user", None, None), ("t2", 6, 99, None, "e", 1.0),
            ("t3", 7, 8, "user", "x", 1.0), ("t3", 8, 7, "user", "y", 1.0)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    out = {(r["tree"], r["leaf"]): chat_format.parse(r["formatted"])
           for r in chat_format.format_trees(df, "tree", "id", "parent", "role", "text", "score", branches=2).collect()}
    assert out == {("t1", 4): [("user", "a"), ("assistant", "b"), ("user", "d")],
                   ("t1", 5): [("user", "a"), ("assistant", "b"), ("user", "")],
                   ("t2", 6): [("", "e")]}


def test_plain_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(70)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (None, 3, None, "n"), (2, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat_format.conversations_as_trees(df)
    out = {r["tree"]: chat_format.parse(r["formatted"])
           for r in chat_format.format_trees(trees, "conv", "id", "parent", "role", "text").collect()}
    assert out == {1: [(r[2], r[3]) for r in rows[:70]], 2: [("system", "first"), ("user", ""), ("user", "")], None: [("", "n")]}
    empty = chat_format.conversations_as_trees(df.limit(0))
    assert chat_format.format_trees(empty, "conv", "id", "parent", "role", "text").count() == 0
