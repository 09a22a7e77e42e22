import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.llm.topk import fixed_point, top_k


def brute(rows, asked, k):
    ids = sorted(rows)
    out = set()
    for q in filter(asked, ids):
        scores = sorted((-sum(x * y for x, y in zip(rows[q], rows[i])), i) for i in ids if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def got(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("shard_bytes", [16_000_000, 8 * 24 * 40])  # one shard; eight
def test_random_vectors_with_ties(spark, shard_bytes):
    draw = np.random.default_rng(1)
    rows = {i: draw.integers(-3, 4, 24).tolist() for i in range(300)}
    rows |= {i: rows[0] for i in range(300, 340)}  # copies: ties at the k-th score
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, terms array<long>")
    assert got(top_k(vectors, F.col("vec_id") % 10 == 0, 5, shard_bytes)) == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_candidates(spark):
    vectors = spark.createDataFrame([(0, [1, 2]), (1, [3, -1]), (2, None), (None, [9, 9])], "vec_id long, terms array<long>")
    assert got(top_k(vectors, F.col("vec_id") == 0, 5)) == {(0, 1, 1, 1)}
    assert got(top_k(vectors.where("vec_id = 0"), F.col("vec_id") == 0, 5)) == set()


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1, 2]), (1, [3, -1]), (1, [5, 5]), (0, [0, 9]), (2, [1])]
    vectors = spark.createDataFrame([(i, t, 7, 7, 7) for i, t in rows], "vec_id long, terms array<long>, shard int, row long, floor long")
    pairs = [(-sum(x * y for x, y in zip(a, b)), j, i) for i, a in rows if i == 0 for j, b in rows if j != i]
    want = [(r, j, -s) for r, (s, j, _) in enumerate(sorted(pairs)[:4], 1)]
    assert sorted((r.rank, r.vec_id, r.score) for r in top_k(vectors, F.col("vec_id") == 0, 4).collect()) == want


def test_large_numbers_stay_exact(spark):
    big = 2**30 + 1
    rows = {0: [big, big], 1: [big, 1], 2: [big, 2], 3: [-big, big]}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, terms array<long>")
    assert got(top_k(vectors, F.col("vec_id") == 0, 3)) == brute(rows, lambda i: i == 0, 3)
    with pytest.raises(OverflowError):
        top_k(spark.createDataFrame([(0, [2**40]), (1, [1])], "vec_id long, terms array<long>"), F.col("vec_id") == 0)


def test_odd_vectors_take_no_part(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -0.001]), (6, [])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    assert {r.vec_id: r.terms for r in fixed_point(df).collect()} == {5: [128, -1], 6: []}
