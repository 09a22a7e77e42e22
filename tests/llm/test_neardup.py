import random

import numpy as np
import pytest
from llm_cases import ODD, colliding_words, documents, near_components

from motionspark.llm import neardup
from motionspark.llm.neardup import components, may_link, near_duplicates, without_near_duplicates


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n, block, stars", [(2, 500, 4), (2, 8, 4), (5, 8, 1)])  # 8: groups are compared star by star, then what is outside with all
def test_against_all_pairs(spark, n, block, stars):
    draw = random.Random(n)
    base = [[f"w{draw.randint(0, 400)}" for _ in range(draw.randint(1, 80))] for _ in range(15)]
    rows = []
    for i in range(200):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = f"w{draw.randint(0, 400)}"
        rows.append((i, draw.choice([str.upper, str.lower])(" ".join(text)), "s"))
    want = near_components([(i, t) for i, t, _ in rows], n, 80)
    assert len({c for _, c in want.values()}) < 160
    assert got(near_duplicates(documents(spark, rows), words=n, block=block, stars=stars)) == want


def test_words_that_polynomials_confuse(spark):
    """Two texts without a common shingle stay apart."""
    one, two = colliding_words()
    rows = [(1, f"{one} same", "s"), (2, f"{two} same", "s")]
    assert got(near_duplicates(documents(spark, rows), words=2)) == {1: (1, 1), 2: (1, 2)}


def test_large_leaf_group(spark):
    """A group with many more members than a leaf, all near copies of one text, is one component."""
    text = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*text, f"extra{i}"]), "s") for i in range(700)]
    found = got(near_duplicates(documents(spark, rows), words=2))
    assert set(found.values()) == {(120, 0)}


def test_near_copies_are_dealt_once_a_depth(spark, monkeypatch):
    """A group of near copies makes 3 rows in each of the 8 trees and 1 in each of the 24 further ones at most, whatever its size; a row a level makes 128 a document."""
    made, staged = [], neardup.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "near-nodes":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    text = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*text, f"extra{i}"]), "s") for i in range(600)]
    assert set(got(near_duplicates(documents(spark, rows), words=2)).values()) == {(300, 0)}
    assert 0 < sum(made) <= 48 * len(rows)


def test_chains_and_stars(spark):
    """Members that the centres do not link to: a chain of texts, each near its neighbours only, and two separate families."""
    draw = random.Random(9)
    word = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word), "s"))
        word = word[3:] + [f"c{i}x{k}" for k in range(3)]
    for i in range(60, 120):
        text = [f"v{k}" for k in range(100)]
        text[draw.randrange(100)] = f"x{i}"
        text[draw.randrange(100)] = f"y{i}"
        if i % 2:
            text[::6] = [f"z{k}" for k in range(17)]  # the other family: similar by half
        rows.append((i, " ".join(text), "s"))
    want = near_components([(i, t) for i, t, _ in rows], 2, 80)
    assert len({c for _, c in want.values()}) == 3
    assert got(near_duplicates(documents(spark, rows), words=2, block=10, block_shingles=500)) == want


def test_deep_pairs_meet(spark):
    """Pairs at 0.8 whose nodes are split down to the last level; 8 trees alone missed 14 of them."""
    draw, pairs = np.random.default_rng(5), 1500
    shared = draw.integers(0, 2**32, (pairs, 128), dtype=np.uint64)
    for level in range(3):
        shared[:, level::4] %= 4
    rows = []
    for i in range(pairs):
        other = np.where(draw.random(128) < 0.8, shared[i], draw.integers(0, 2**32, 128, dtype=np.uint64))
        rows += [(2 * i, 10, bytearray(shared[i].astype("<u4").tobytes())), (2 * i + 1, 10, bytearray(other.astype("<u4").tobytes()))]
    classes = spark.createDataFrame(rows, "doc long, n_shingles int, minwise binary")
    found = {(r.a, r.b) for r in may_link(classes, 8, 4, 8, 0.5, 0.8).collect()}
    assert sum((2 * i, 2 * i + 1) not in found for i in range(pairs)) <= 2


def test_odd_documents(spark):
    rows = [(i, t, s) for i, t, s in ODD if i is not None]
    found = near_duplicates(documents(spark, ODD), words=2)
    with_id = {k: v for k, v in got(found).items() if k is not None}
    assert with_id == near_components([(i, t) for i, t, _ in rows], 2, 80)
    assert found.count() == len(ODD)


def test_ids_do_not_link(spark):
    """Texts that share an id or have none are linked by their words only."""
    base = lambda name: [f"{name}{i}" for i in range(60)]
    text = lambda name, *more: " ".join([*base(name), *more])
    rows = [(7, text("a"), "s"), (None, text("a", "x"), "s"), (None, text("b"), "s"), (None, text("c"), "s"), (None, text("c", "y"), "s"), (8, text("b", "z"), "s"), (20, text("d"), "s"), (20, text("e"), "s"), (3, text("e", "v"), "s")]
    left = sorted((r.text.split()[0], r.doc_id or 0) for r in without_near_duplicates(documents(spark, rows), words=2).collect())
    assert left == [("a0", 7), ("b0", 8), ("c0", 0), ("d0", 20), ("e0", 3)]


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ODD)
    left = without_near_duplicates(docs, words=5)
    assert left.columns == docs.columns
    rows = left.collect()
    ids = [r.doc_id for r in rows]
    # 5 is a copy of 1, repeated rows meet, 8 is near 7, 10 is 9 in capitals; empty texts stay
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 9]
    assert all(r["_doc"] == "x" and r["_row"] == "x" for r in rows)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99)], "a long, b long")
    root = {r.node: r.root for r in components(links, "test").collect()}
    assert root == {i: 1 for i in range(1, 41)} | {99: 99, 100: 99}
