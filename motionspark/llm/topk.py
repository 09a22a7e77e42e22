"""Exact top-k search by inner product with MaxScore.

A vector's terms are its dimensions; a term's postings hold every vector. Within a shard of candidates every
term has a most and a least that it can add to a query's score. Terms are ordered by how far these lie
apart. The longest tail whose bounds cannot lift a candidate over the k-th score is non-essential: the others'
postings are traversed for the whole shard, those of the tail are probed only for candidates that can still
compete, while the k-th score rises with what is sure already. The k best of each shard are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Bytes of one shard of candidates, and of one block of queries, as numbers of 8 bytes.
SHARD_BYTES = 16_000_000
EXACT_FLOAT, EXACT_LONG = 2**53, 2**63
PROBE = 8  # non-essential terms that are probed at a time
RESULT = "query_row long, query_id long, vec_id long, score long"


def max_score(queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's index, ids, scores) of each query's ``k`` best in a shard, ties to the smaller id.

    ``shard``: candidates by dimension, sorted by id. ``own[i]``: the id left out for query i. ``floors[i]``:
    a score that k candidates elsewhere reach, so lower ones may be left out. Numbers are integers, in
    float64 or int64, in which all sums are exact.
    """
    by_term = np.ascontiguousarray(shard.T)
    top, low = by_term.max(axis=1), by_term.min(axis=1)
    for i, q in enumerate(queries):
        most, least = np.maximum(q * top, q * low), np.minimum(q * top, q * low)  # what a term can add
        order = np.argsort(least - most, kind="stable")  # widest terms first
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # the most the terms from a place on can add
        sure = np.append(np.cumsum(least[order][::-1])[::-1], 0)
        others = np.flatnonzero(ids != own[i])
        if not len(others):
            continue
        floor = floors[i]
        if len(others) >= k:  # a first k-th score: that of the candidates that lead on the widest terms
            wide = order[: max(1, len(order) // 8)]
            first = others[np.argpartition(-(q[wide] @ by_term[wide])[others], k - 1)[:k]]
            floor = max(floor, (shard[first] @ q).min())
        # Non-essential is the longest tail that cannot lift a candidate over the floor if it has no more than the least on the others.
        lifted = np.append(0, np.cumsum(least[order])) + rest
        done = max(1, int(np.argmax(lifted < floor)) if (lifted < floor).any() else len(order))
        score = (q[order[:done]] @ by_term[order[:done]])[others]
        able = score + rest[done] >= floor
        alive, score = others[able], score[able]
        while done < len(order) and len(alive):
            if len(alive) > k:
                floor = max(floor, np.partition(score + sure[done], -k)[-k])
            step = order[done : done + PROBE]
            score = score + q[step] @ by_term[np.ix_(step, alive)]
            done += len(step)
            able = score + rest[done] >= floor
            alive, score = alive[able], score[able]
        best = np.lexsort((ids[alive], -score))[:k]
        yield i, ids[alive[best]], score[best]


def _matrix(rows: pd.Series, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, query_ids, k: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``k`` highest inner products of each query with every other vector: query_id, rank, vec_id, score.

    ``vectors``: vec_id long, terms array<long>. ``query_ids``: a Column condition on vec_id that picks
    the queries. Candidates go to shards by hash and queries to blocks, each of bounded bytes, and a task
    sees one shard and one block. The first shard is searched first; each query's k-th score there is its
    floor for all others.

    Defined cases: rows with a null vec_id or null terms take no part; every row is a candidate, also of ids
    that repeat, and the rows of a repeated id that are queries share one list of k; missing components count as
    0; with no candidates there are no rows; other columns are ignored. Sums are exact up to 2**63, beyond
    which OverflowError is raised.
    """
    numbered = vectors.where(F.col("vec_id").isNotNull() & F.col("terms").isNotNull()).select("vec_id", "terms", F.monotonically_increasing_id().alias("row"))
    one = staged(numbered, "vectors")
    size = F.aggregate("terms", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, n_queries, width, largest = one.select(F.count(F.lit(1)), F.count(F.when(query_ids, 1)), F.max(F.size("terms")), F.max(size)).first()
    width = max(width or 1, 1)
    bound = width * int(largest or 0) ** 2
    if bound >= EXACT_LONG:
        raise OverflowError("inner products may pass 2**63")
    kind = np.float64 if bound < EXACT_FLOAT else np.int64
    lowest = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    rows = max(k, shard_bytes // (8 * width))
    shards, blocks = max(1, math.ceil(n / rows)), max(1, math.ceil(n_queries / rows))
    hashed = F.xxhash64("vec_id", "row")
    candidates = one.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int"))
    block = F.pmod(F.shiftright(hashed, 20), F.lit(blocks)).cast("int").alias("block")
    queries = one.where(query_ids).select(F.col("vec_id").alias("asked_id"), F.col("terms").alias("asked"), F.col("row").alias("asked_row"), block)

    def search(cands: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if cands.empty or asked.empty:
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")}, dtype="int64")
        cands = cands.sort_values("vec_id")
        own, ids = asked["asked_id"].to_numpy(), cands["vec_id"].to_numpy()
        floors = [lowest if pd.isna(x) else kind(x) for x in asked["floor"]]
        found = list(max_score(_matrix(asked["asked"], width, kind), ids, _matrix(cands["terms"], width, kind), own, k, floors))
        at, sizes = [i for i, _, _ in found], [len(x) for _, x, _ in found]
        joined = lambda parts: np.concatenate(parts) if parts else []
        columns = {"query_row": asked["asked_row"].to_numpy()[at].repeat(sizes), "query_id": own[at].repeat(sizes), "vec_id": joined([x for _, x, _ in found]), "score": joined([s for _, _, s in found])}
        return pd.DataFrame(columns).astype("int64")

    def over(some: DataFrame, floored: DataFrame, of: list[int]) -> DataFrame:
        """The search of some shards, each against every block."""
        spread = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
        left = some.withColumn("block", spread(0, blocks - 1)).groupBy("shard", "block")
        right = floored.withColumn("shard", spread(of[0], of[-1])).groupBy("shard", "block")
        return left.cogroup(right).applyInPandas(search, RESULT)

    found = over(candidates.where("shard = 0"), queries.withColumn("floor", F.lit(None).cast("long")), [0])
    if shards > 1:
        found = staged(found, "topk-first")
        floors = found.groupBy(F.col("query_row").alias("asked_row")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor")).where(F.col("_n") >= k).select("asked_row", "floor")
        found = found.unionByName(over(candidates.where("shard > 0"), queries.join(floors, "asked_row", "left"), [1, shards - 1]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fixed_point(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, terms: each component x as floor(scale * x); vectors null or with a null or non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", scaled.alias("terms"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(fixed_point(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS t FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
