import math
import random
import re
from collections import Counter

import pytest
from llm_cases import ODD, documents

from motionspark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if null else doc_id, -score))
    return sorted(out, key=repr)


def found_by(spark, docs, items, k=10):
    d = documents(spark, [(i, t, "web") for i, t in docs])
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r)[:4] for r in ranked.ranked_search(d, q, k).collect()), key=repr)


def corpus(draw, n):
    words = [f"w{i}" for i in range(60)] + ["Éa", "漢字", "x1Y", "\x80z"]
    weights = [1 / (i + 1) for i in range(len(words))]
    marks = [" ", "-", "\n", "_", "!"]
    return [(i, "".join(w + draw.choice(marks) for w in draw.choices(words, weights, k=int(2 ** draw.uniform(0, 9))))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_scoring_everything(spark, seed):
    draw = random.Random(seed)
    docs = corpus(draw, 300)
    docs += docs[:30] + [(None, docs[5][1]), (None, None), (900, ""), (901, "!!!")]  # ties, repeated rows, null ids
    items = [(i, " ".join(draw.choices([f"w{i}" for i in range(70)], k=draw.randint(1, 12)))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "nowhere"), (28, docs[7][1]), (29, "W1 w1 W1")]
    assert found_by(spark, docs, items) == by_hand(docs, items)


def test_small_shards_tiers_and_rounds(spark, monkeypatch):
    """Results do not depend on shards, tiers or rounds, and items are proved in every tier."""
    draw = random.Random(5)
    docs = corpus(draw, 250) + [(1000 + i, "rare0 rare1 rare2 " * 3 + f"pad{i}") for i in range(12)]
    items = [(i, " ".join(draw.choices([f"w{i}" for i in range(64)], k=6))) for i in range(10)] + [(50, "rare0 rare1 rare2"), (51, "rare0 w0 w1")]
    want = by_hand(docs, items, 3)
    monkeypatch.setattr(ranked, "SHARD_DOCS", 7)
    monkeypatch.setattr(ranked, "ITEM_BYTES", 60)
    for shares in ((0.3, 0.65), (0.01, 0.02), (0.9, 0.95), (1.0, 1.0)):
        monkeypatch.setattr(ranked, "SHARES", shares)
        assert found_by(spark, docs, items, 3) == want
    tiers = {r.item_id: r.tier for r in ranked.ranked_search(documents(spark, [(i, t, "web") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), 3).collect()}
    assert tiers[50] == 0
    monkeypatch.setattr(ranked, "SHARES", (0.01, 0.02))
    d, q = documents(spark, [(i, t, "web") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    assert {r.tier for r in ranked.ranked_search(d, q, 3).collect()} >= {2}


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, t) for i, t, _ in ODD]
    items = [(1, "alpha"), (1, "tie W9"), (None, "beta"), (3, None)]
    assert found_by(spark, rows, items) == by_hand(rows, items)
    assert found_by(spark, [(1, "!")], items) == [] and found_by(spark, rows, [(1, "")]) == []


def test_terms():
    for text in ("It's x1-Y2_z", "É\x80\xa0b", "漢字,かな", "\x00a\x7fb[c`d{e/f:g@h", ""):
        assert [t.decode() for t in ranked.terms(text.encode())] == terms(text)
