import random

import pytest
from llm_cases import ODD, colliding_words, documents, words

from motionspark.llm.substrings import LAST, SuffixAutomaton, remove_repeats


def brute(rows, window):
    """Multiset of (doc_id, n_words, n_removed, kept): each window looked up among all documents."""
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()], key=repr)


@pytest.mark.parametrize("most", [1, 5, 1_000])  # 1: nearly every shard is parted down to single windows
def test_random_texts(spark, most):
    draw = random.Random(3)
    shared = [[draw.choice("abcdefgh") for _ in range(draw.randint(6, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = [w for _ in range(draw.randint(0, 4)) for w in (draw.choice(shared) if draw.random() < 0.5 else [draw.choice("abcdefghijkl") for _ in range(draw.randint(1, 15))])]
        rows.append((draw.choice([i, i, i, None, 7]), " ".join(text), "s"))
    assert got(remove_repeats(documents(spark, rows), window=6, anchor=2, most=most)) == brute(rows, 6)


def test_words_that_polynomials_confuse(spark):
    one, two = colliding_words()
    head, tail = " ".join(f"h{i}" for i in range(30)), " ".join(f"t{i}" for i in range(30))
    rows = [(1, f"{head} {one} {tail}", "s"), (2, f"{head} {two} {tail}", "s"), (3, f"{head} {one} {tail}", "s")]
    found = got(remove_repeats(documents(spark, rows)))
    assert found == brute(rows, 50)
    assert [n for _, _, n, _ in found] == [0, 0, 61]


def test_a_crowded_passage(spark):
    """A passage with other words about it in each document: its shard is parted, by ranges and then windows."""
    passage = [f"p{i}" for i in range(55)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + passage + [f"b{i % 3}x{k}" for k in range(30)]), "s") for i in range(40)]
    assert got(remove_repeats(documents(spark, rows), most=4)) == brute(rows, 50)


def test_odd_documents(spark):
    assert got(remove_repeats(documents(spark, ODD))) == brute(ODD, 50)


def test_automaton_owners():
    automaton = SuffixAutomaton()
    automaton.add(list("abcabd"), 4)
    automaton.add(list("xbcaby"), 9)
    assert automaton.first_owners(list("xbcabd"), 3) == [9, 4, 4, 4]
    assert automaton.first_owners(list("zzz"), 3) == [-1]
