from hypothesis import given
from hypothesis import strategies as st

from motionspark.llm.chat import HARD_TEXT, best_paths, format_paths, format_turns, linear_trees, read_back, read_turns, unescape

pieces = st.lists(st.sampled_from(["###", "</turn>", "\\", " ", "\n", ":", "### user: ", " </turn>\n", "a", "é🙂", "#"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), pieces), pieces), max_size=4))
def test_round_trip(turns):
    formatted, mask = format_turns([r for r, _ in turns], [t for _, t in turns])
    assert read_turns(formatted) == turns
    assert "".join(unescape(formatted[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def tree(spark):
    """Tree 1: 1 - (2 - (4, 5 - 7)), 3. Tree 2: one node; tree 3: two roots."""
    rows = [(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 2, 0.0), (1, 7, 5, 3.0), (2, 1, None, None), (3, 1, None, 1.0), (3, 2, 99, 4.0)]
    return spark.createDataFrame([(t, n, p, "user" if n == 1 else "assistant", f"m{n}" if n != 7 else None, s) for t, n, p, s in rows], "tree long, node long, parent long, role string, text string, score double")


def test_branches_are_ranked(spark):
    paths = {}
    for r in best_paths(tree(spark), branches=3).collect():
        paths.setdefault((r.tree, r.branch), {})[r.back] = r.node
    found = {k: [v[b] for b in sorted(v, reverse=True)] for k, v in paths.items()}
    # mean scores in tree 1: 1-2-4 has 4, 1-3 has 3, 1-2-5-7 has 1.5
    assert found == {(1, 1): [1, 2, 4], (1, 2): [1, 3], (1, 3): [1, 2, 5, 7], (2, 1): [1], (3, 1): [2], (3, 2): [1]}


def test_long_chain_and_cycles(spark):
    """A cycle without a leaf, and one that a leaf hangs on: neither has a way to a root, other branches stay."""
    rows = [(1, i, i - 1 if i > 1 else None) for i in range(1, 71)]
    rows += [(2, 1, 2), (2, 2, 1)]
    rows += [(3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, None), (3, 5, 4), (3, 6, 6)]
    rows += [(4, 1, 1)]
    nodes = spark.createDataFrame([(t, n, p, 1.0) for t, n, p in rows], "tree long, node long, parent long, score double")
    paths = {}
    for r in best_paths(nodes, branches=5).collect():
        paths.setdefault((r.tree, r.branch), {})[r.back] = r.node
    assert paths == {(1, 1): {i: 70 - i for i in range(70)}, (3, 1): {0: 5, 1: 4}}


def test_odd_rows(spark):
    """Null trees and nodes, repeated nodes and clashing columns."""
    rows = [(None, 1, None, 1.0), (1, None, None, 1.0), (1, 1, None, 1.0), (1, 1, None, 3.0), (1, 2, 1, None), (1, 2, 1, None)]
    nodes = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "tree long, node long, parent long, score double, up string, leaf string, sum string")
    assert sorted((r.tree, r.back, r.node) for r in best_paths(nodes).collect()) == [(1, 0, 2), (1, 1, 1)]


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, None, "b"), (None, None, "assistant", "c"), (1, 1, "assistant", None)]
    said = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, tree string, node string")
    back = {r.tree.id if not r.tree.none else None: r for r in read_back(format_paths(linear_trees(said))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "a"), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in back[None].turns] == [("assistant", "c"), ("", "b")] and back[None].loss_text == "c"


def test_formatted_and_read_back(spark):
    hard = spark.createDataFrame([(5, 1, None, "user", HARD_TEXT, 1.0), (5, 2, 1, "assistant", HARD_TEXT, 1.0)], tree(spark).schema)
    rows = {(r.tree, r.branch): r for r in read_back(format_paths(tree(spark).unionByName(hard), 3)).collect()}
    assert [tuple(t) for t in rows[1, 3].turns] == [("user", "m1"), ("assistant", "m2"), ("assistant", "m5"), ("assistant", "")]
    assert rows[1, 3].loss_text == "m2m5"
    assert [t.text for t in rows[5, 1].turns] == [HARD_TEXT] * 2 and rows[5, 1].loss_text == HARD_TEXT
