"""Ranked lexical search through a tiered index.

The texts become shards of postings, written once, each of documents whose lengths are alike within a doubling. A
posting's impact is what its term adds to a document's score. The highest impacts of the whole index are its first
tier, the next ones its second, the others its last. What a lower tier can still add at most is a term's residual
bound, kept for each length: impacts fall with length, and a document of n terms can gain from n of them only.

Items are searched in the first tier. Where an item's k-th partial score lies above the sum of its residual bounds, it is
proved for the documents of that length: of them only those that still reach that score are probed in the lower tiers. Where proof
is lacking, the item falls through to the next tier, the last of which leaves no residual.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import drop_staged, staged, table

#: Bytes of items' texts that are searched at a time: their terms are broadcast, and further items take further rounds.
ITEM_BYTES = 1_000_000
#: Documents and occurrences of items' terms in a shard, whichever comes first.
SHARD_DOCS, SHARD_TERMS = 4_096, 1_000_000
#: Share of all postings in the tiers before the last one.
SHARES = (0.3, 0.65)
TIERS = len(SHARES) + 1
#: Lengths of documents are told apart by doublings.
DOUBLINGS = 40

_table = bytearray(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))
_table[65:91] = bytes(range(97, 123))
_table = bytes(_table)

SHARDS = "ids binary, unnamed binary, sizes binary, term binary, doc binary, tf binary, length int, holding long, words long"
TIERED = "length int, ids binary, unnamed binary, " + ", ".join(f"term{j} binary, doc{j} binary, impact{j} binary" for j in range(TIERS)) + ", terms binary, " + ", ".join(f"low{j} binary" for j in range(TIERS - 1))
FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: ASCII letters and digits and all other characters hold together; A-Z are lower-cased."""
    return text.translate(_table).split()


def _batch(columns: list, ddl: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    split = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, split)], [n for n, _ in split])


class _Shard:
    """Documents of one length that a task has read, until they are written."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.seen: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, size: int, known: list[int]) -> bool:
        """Whether the shard is full with this document."""
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.seen.append(np.array(known, np.int32))
        self.held += len(known)
        return len(self.ids) >= SHARD_DOCS or self.held >= SHARD_TERMS

    def row(self, length: int, holding: int, words: int) -> pa.RecordBatch:
        each = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.seen])
        width = max(len(self.ids), 1)
        key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *self.seen]).astype(np.int64) * width + each, return_counts=True)
        term, doc = np.divmod(key, width)
        parts = [np.array([i or 0 for i in self.ids], np.int64), np.array([i is None for i in self.ids], bool), np.array(self.sizes, np.int64), term.astype(np.int32), doc.astype(np.int32), tf.astype(np.int64)]
        return _batch([*[[p.tobytes()] for p in parts], [length], [holding], [words]], SHARDS)


def _shard_rows(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows of SHARDS: postings of the numbered terms, by term and document, and what all documents add to the statistics."""
    shards: dict[int, _Shard] = {}
    holding = words = 0
    for batch in batches:
        for a, b, texts in wh.batches(batch):
            for doc_id, text in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), texts):
                found = terms(text)
                holding, words = holding + bool(found), words + len(found)
                known = [i for i in map(number.get, found) if i is not None]
                length = len(found).bit_length()
                if known and shards.setdefault(length, _Shard()).add(doc_id, len(found), known):
                    yield shards.pop(length).row(length, holding, words)
                    holding = words = 0
    for length, shard in shards.items():
        yield shard.row(length, holding, words)
        holding = words = 0
    if holding:
        yield _Shard().row(0, holding, words)


def _arrays(batch: pa.RecordBatch, kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    columns = {name: batch.column(name) for name in kinds}
    for i in range(batch.num_rows):
        yield {name: np.frombuffer(columns[name][i].as_buffer(), kind) for name, kind in kinds.items()}


POSTINGS = {"sizes": np.int64, "term": np.int32, "doc": np.int32, "tf": np.int64}


class Statistics:
    """What scores depend on beyond a document: N, L and a weight for each numbered term."""

    def __init__(self, documents: int, words: int, frequency: np.ndarray):
        self.documents, self.words = documents, words
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)

    def impacts(self, shard: dict[str, np.ndarray]) -> np.ndarray:
        """What each posting adds to its document's score, in whole numbers."""
        m = 100 - 90 + (90 * shard["sizes"] * self.documents) // self.words
        tf = shard["tf"]
        return self.weights[shard["term"]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[shard["doc"]]))


def _steps(impacts: np.ndarray) -> np.ndarray:
    """Sixteen steps for each power of two."""
    return np.where(impacts > 0, np.floor(16 * np.log2(np.maximum(impacts, 1))), 0).astype(np.int64)


def _counted(df: DataFrame, of, length: int) -> np.ndarray:
    """Sum over all tasks of the ``length`` numbers that ``of(batch)`` adds for a batch; one row of each a task reaches the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += of(batch)
        at = np.flatnonzero(total)
        yield _batch([at.astype(np.int32), total[at]], "at int, n long")

    out = np.zeros(length, np.int64)
    for r in df.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _tiered_rows(batches: Iterator[pa.RecordBatch], statistics: Statistics, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of TIERED: each shard's postings by tier, term and document, and the most of each term below each tier."""
    for batch in batches:
        for i, shard in enumerate(_arrays(batch, POSTINGS)):
            impacts = statistics.impacts(shard)
            tier = sum((_steps(impacts) < b).astype(int) for b in bounds)
            known = np.unique(shard["term"])
            place, parts, low = np.searchsorted(known, shard["term"]), [], []
            for j in range(TIERS):
                mine = tier == j
                parts += [shard["term"][mine], shard["doc"][mine], impacts[mine]]
                if j < TIERS - 1:
                    most = np.zeros(len(known), np.int64)
                    np.maximum.at(most, place[tier > j], impacts[tier > j])
                    low.append(most)
            yield _batch([[batch.column("length")[i].as_py()], [batch.column("ids")[i].as_py()], [batch.column("unnamed")[i].as_py()], *[[p.tobytes()] for p in (*parts, known, *low)]], TIERED)


def _sums(asked: np.ndarray, tiers: list[dict[str, np.ndarray]], docs: int) -> np.ndarray:
    """Each document's score by the asked terms' postings in some tiers."""
    score = np.zeros(docs)
    for t in tiers:
        starts, ends = np.searchsorted(t["term"], asked, "left"), np.searchsorted(t["term"], asked, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b > a] or [np.zeros(0, int)])
        if len(at):
            score += np.bincount(t["doc"][at], t["impact"][at], docs)  # whole numbers below 2**53 are exact
    return score


def _probe(asked: np.ndarray, tiers: list[dict[str, np.ndarray]], docs: np.ndarray) -> np.ndarray:
    """What some tiers add to some documents."""
    out = np.zeros(len(docs))
    for t in tiers:
        for a, b in zip(np.searchsorted(t["term"], asked, "left").tolist(), np.searchsorted(t["term"], asked, "right").tolist()):
            at = a + np.searchsorted(t["doc"][a:b], docs)
            hit = at < b
            hit[hit] = t["doc"][at[hit]] == docs[hit]
            out[hit] += t["impact"][at[hit]]
    return out


def _best(score: np.ndarray, docs: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, of equal ones by id, null ids last."""
    if len(score) > k:
        able = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        able = np.arange(len(score))
    order = np.lexsort((ids[docs[able]], unnamed[docs[able]], -score[able]))
    return able[order[:k]]


class Proofs:
    """For each item its k-th score so far, and by length of documents the tier that proved it and what is left behind that."""

    def __init__(self) -> None:
        self.floors: dict[int, int] = {}
        self.levels: dict[int, np.ndarray] = {}
        self.left: dict[int, np.ndarray] = {}

    def judge(self, tier: int, items: list[tuple[int, np.ndarray]], residual: np.ndarray) -> None:
        """Take the items' proofs from a tier; ``residual`` has the most of each length and term behind it."""
        for item, asked in items:
            levels, left = self.levels.setdefault(item, np.full(DOUBLINGS, TIERS - 1)), self.left.setdefault(item, np.zeros(DOUBLINGS, np.int64))
            if item in self.floors:
                most = np.sort(residual[:, asked], axis=1)[:, ::-1]
                rest = np.array([row[: 2**length - 1].sum() for length, row in enumerate(most)])
                proved = (levels == TIERS - 1) & (self.floors[item] > rest)
                levels[proved], left[proved] = tier, rest[proved]

    def open(self, item: int, lengths: np.ndarray) -> bool:
        """Whether the item lacks proof for documents of some length that there are."""
        return item not in self.levels or bool((self.levels[item][lengths] == TIERS - 1).any())


def _search(tiered: DataFrame, items: list[tuple[int, np.ndarray]], proofs: Proofs, top: int, k: int) -> DataFrame:
    """Rows of FOUND: each shard's ``k`` best for every item by the tiers up to ``top``, from its floor on.

    In the last tier an item that is proved for a shard's length is summed up to the tier of its proof, and what can still reach the floor is
    probed in the tiers behind.
    """
    shared = tiered.sparkSession.sparkContext.broadcast((items, proofs))
    names = [f"{c}{j}" for j in range(top + 1) for c in ("term", "doc", "impact")]
    kinds = {n: np.int64 if n.startswith("impact") else np.int32 for n in names} | {"ids": np.int64, "unnamed": np.bool_}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, proofs = shared.value
        for batch in batches:
            for length, shard in zip(batch.column("length").to_pylist(), _arrays(batch, kinds)):
                tiers = [{c: shard[f"{c}{j}"] for c in ("term", "doc", "impact")} for j in range(top + 1)]
                out: list[list] = [[], [], []]
                for item, asked in items:
                    floor, level, left = max(proofs.floors.get(item, 1), 1), top, 0
                    if top == TIERS - 1 and item in proofs.levels:
                        level, left = proofs.levels[item][length], proofs.left[item][length]
                    score = _sums(asked, tiers[: level + 1], len(shard["ids"]))
                    docs = np.flatnonzero(score + left >= floor)
                    score = score[docs] + (_probe(asked, tiers[level + 1 :], docs) if level < top and len(docs) else 0)
                    docs, score = docs[score >= floor], score[score >= floor]
                    best = _best(score, docs, shard["ids"], shard["unnamed"], k)
                    at = docs[best]
                    out[0] += [item] * len(at)
                    out[1] += [None if u else i for u, i in zip(shard["unnamed"][at].tolist(), shard["ids"][at].tolist())]
                    out[2] += score[best].astype(np.int64).tolist()
                yield _batch(out, FOUND)

    return tiered.select("length", "ids", "unnamed", *names).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rank_some(docs: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """item_id, rank, doc_id, score and tier for items (id, text) that are searched together; None if they have no terms."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    asked = [(i, np.unique([number.setdefault(t, len(number)) for t in terms((text or "").encode())]).astype(np.int32)) for i, (_, text) in enumerate(items)]
    asked = [(i, t) for i, t in asked if len(t)]
    if not asked:
        return None
    numbers = spark.sparkContext.broadcast(number)
    shards = staged(docs.select("doc_id", "text").mapInArrow(lambda batches: _shard_rows(batches, numbers.value), SHARDS), "ranked-shards")
    documents, words = shards.agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not documents:
        return None
    vocabulary, postings = len(number), {"term": np.int32}  # the tasks below take the number, not the terms
    each_term = lambda batch: sum(np.bincount(s["term"], minlength=vocabulary) for s in _arrays(batch, postings))
    statistics = Statistics(documents, words, _counted(shards.select("term"), each_term, vocabulary))
    each_step = lambda batch: sum(np.bincount(_steps(statistics.impacts(s)), minlength=1_024) for s in _arrays(batch, POSTINGS))
    steps = _counted(shards.select(*POSTINGS), each_step, 1_024)
    above = np.cumsum(steps[::-1])[::-1]  # postings of a step or more
    bounds = [int(np.argmax(above <= share * above[0])) for share in SHARES]
    tiered = staged(shards.mapInArrow(lambda batches: _tiered_rows(batches, statistics, bounds), TIERED), "ranked-tiers")
    drop_staged(shards)

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((TIERS - 1, DOUBLINGS, vocabulary), np.int64)
        for batch in batches:
            for length, s in zip(batch.column("length").to_pylist(), _arrays(batch, {"terms": np.int32} | {f"low{j}": np.int64 for j in range(TIERS - 1)})):
                for j in range(TIERS - 1):
                    most[j, length, s["terms"]] = np.maximum(most[j, length, s["terms"]], s[f"low{j}"])
        at = np.flatnonzero(most)
        yield _batch([at.astype(np.int64), most.ravel()[at]], "at long, most long")

    residual = np.zeros((TIERS - 1, DOUBLINGS, vocabulary), np.int64)
    for r in tiered.select("length", "terms", *[f"low{j}" for j in range(TIERS - 1)]).mapInArrow(lows, "at long, most long").groupBy("at").agg(F.max("most").alias("most")).collect():
        residual.ravel()[r["at"]] = r["most"]
    lengths = np.array([r["length"] for r in tiered.select("length").distinct().collect()])

    proofs = Proofs()
    for tier in range(TIERS - 1):
        if open_items := [(i, t) for i, t in asked if proofs.open(i, lengths)]:
            kth = _ranked(_search(tiered, open_items, proofs, tier, k), k).where(F.col("rank") == k).select("item", "score")
            proofs.floors |= {r["item"]: r["score"] for r in kth.collect()}
            proofs.judge(tier, open_items, residual[tier])
    found = _ranked(_search(tiered, asked, proofs, TIERS - 1, k), k)
    lowest = lambda i: int(proofs.levels[i][lengths].max())
    named = spark.createDataFrame([(i, items[i][0], lowest(i)) for i, _ in asked], "item int, item_id long, tier int")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score", "tier")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score and tier (the lowest that some of the item's proof needs): each item's ``k`` highest-scoring documents.

    ``docs``: doc_id long, text; ``items``: item_id long, text. Terms are counted over whole texts, of any length. Documents
    with null or empty texts are in no statistic and no result; null ids are ranked last among equals; rows that repeat
    are documents, and items, of their own; an item without terms, or whose terms no document has, has no rows, and neither has
    an empty table; other columns do not matter. Items go in rounds of ITEM_BYTES of text, each held by the driver and broadcast.
    """
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(size / ITEM_BYTES))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)).alias("_round"))
    parts = []
    for n in range(rounds):
        rows = [tuple(r) for r in dealt.where(F.col("_round") == n).select("item_id", "text").collect()]
        parts.append(_rank_some(docs, rows, k))
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tier")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
i AS (SELECT q.item_id, d.doc_id, d.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * len(d.t) * s.n_docs) // s.l)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY q.item_id, d.doc_id, d.r HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM i QUALIFY rank <= 10
"""
