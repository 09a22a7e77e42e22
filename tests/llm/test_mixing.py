import random
from collections import defaultdict

import pytest
from llm_cases import ODD, documents, words

from motionspark.llm.mixing import mix, mixed_documents


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over


def rows_of(seed):
    draw = random.Random(seed)
    sources = ["web"] * 50 + ["code", "book", None, "wiki", ""]
    return [(i, " ".join("w" * draw.randint(0, 40)), draw.choice(sources)) for i in range(600)]


@pytest.mark.parametrize("rows", [rows_of(1), rows_of(2), ODD])
def test_budgets(spark, rows):
    found = mix(documents(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.size) for r in found) == sorted((repr(i), len(words(t))) for i, t, _ in rows)
    sizes, taken, docs = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        docs[r.source] = r
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert docs[s].source_size == sizes[s] and docs[s].target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.5
    again = sorted(map(tuple, mix(documents(spark, rows).repartition(7)).collect()), key=repr)
    assert again == sorted(map(tuple, found), key=repr)


def test_no_words(spark):
    rows = mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_documents_repeat(spark):
    docs = documents(spark, rows_of(3))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: (r.taken, r.size) for r in mix(docs).collect()}
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert count == {i: n for i, (t, s) in taken.items() if (n := int(t / max(s, 1) + 0.5))}


def test_a_source_keeps_its_first_document(spark):
    """A source whose only document is far longer than its target does not vanish."""
    rows = [(1, "w " * 1000, "a"), (2, "w " * 10_000, "b")] + [(10 + i, "w " * 100, "c") for i in range(20)]
    left = {r.source for r in mixed_documents(documents(spark, rows), weights=(50, 1, 50)).collect()}
    assert left == {"a", "b", "c"}
