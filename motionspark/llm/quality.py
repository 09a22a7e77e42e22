"""A quality classifier by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its pairs of neighbouring bytes (hashed to ``PAIRS`` slots) and a few terms for its
form: words that repeat the one before, that came up before, short and long words, marks, digits,
capitals. Terms are weighted by inverse document frequency over all documents and projected on the leading
singular directions of a bounded sample of labelled documents. The sample's vectors are broadcast; each
document's cosines with all of them are computed exactly, block by block, and its nearest labelled
neighbours vote with the weight of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import table

#: The most labelled documents that are fitted on and broadcast (with RANK numbers of 4 bytes each).
SAMPLE = 4_096
PAIRS, FORMS, RANK, NEIGHBOURS = 2_048, 8, 64, 25
SQUARINGS = 3  # a vote weighs its similarity squared three times
SHARPNESS = 2**SQUARINGS
TERMS = PAIRS + FORMS
THRESHOLD = 0.3

_slots = (np.arange(65_536, dtype=np.uint64) * np.uint64(wh.P) >> np.uint64(40)).astype(np.intp) % PAIRS
#: Rows of counts that are held at once.
ROWS = 512
#: Bits behind the point of unit vectors: a product of two has twice as many and stays below 2**53.
BITS = 24
_forms = np.zeros((256, 4))  # marks, digits, capitals, line ends
_forms[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 0] = 1
_forms[48:58, 1] = _forms[65:91, 2] = _forms[10, 3] = 1


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Shares of the terms of each text, one row each."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts):
        raw = np.frombuffer(text, np.uint8)
        if not len(raw):
            row[PAIRS + 7] = 1
            continue
        pairs = raw[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= raw[1:]
        row[:PAIRS] = np.bincount(_slots[pairs], minlength=PAIRS)
        row[:PAIRS] /= max(len(pairs), 1)
        row[PAIRS : PAIRS + 4] = np.bincount(raw, minlength=256) @ _forms / len(raw)
        words = text.split()  # by the white space of WORD
        if words:
            row[PAIRS + 4] = sum(map(eq, words, words[1:])) / len(words)
            row[PAIRS + 5] = 1 - len(set(words)) / len(words)
            row[PAIRS + 6] = len(words) / len(raw)
    return out


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a, b, texts in wh.batches(batch, rows=ROWS):
            yield batch.slice(a, b - a), term_counts(texts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents) of one task: how many of its documents have each term."""
    n = np.zeros(TERMS + 1, np.int64)  # the last one counts documents
    for rows, counts in _per_document(batches):
        n[:TERMS] += (counts > 0).sum(axis=0)
        n[TERMS] += rows.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(n)], ["term", "documents"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, counts in _per_document(batches):
        yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("place"), pa.array([c.tobytes() for c in counts], pa.binary())], ["label", "place", "counts"])


def whole(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiples of 2**-bits as whole numbers, kept as doubles.

    Sums of products of whole numbers below 2**53 have no rounding, so they are the same in any order: a
    product of matrices then gives a row the same numbers wherever it stands and whatever stands beside it.
    """
    return np.rint(np.ldexp(x.astype(np.float64), bits))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers (squares adding up to less than 2**53) brought to length 1, as multiples of 2**-BITS."""
    return whole(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12), BITS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square-rooted shares by idf, each row of length 1."""
    return np.ldexp(unit_rows(whole(np.sqrt(counts) * idf, BITS - 6)), -BITS)  # 6 bits for an idf of up to 64


def directions(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(5).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return basis @ turn[:rank].T


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The idf over all documents, the projection, and the sample's vectors and labels; None without labels.

    Only labels of ids whose remainder is not 0 are used, the first ``sample`` of them by a hash of the id.
    """
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0))
    each = quality.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    # Terms are counted where the texts are; one task then orders no more than rows of counts.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text", place.alias("place"))
    counted_rows = labelled.mapInArrow(_sample_rows, "label double, place struct<h:long,doc_id:long,t:long>, counts binary")
    rows = counted_rows.orderBy("place").limit(sample).select("label", "counts").collect()
    if not rows:
        return None
    counted = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(_frequencies, "term int, documents long").groupBy("term").agg(F.sum("documents").alias("n")).collect()}
    n = counted[TERMS]
    idf = np.array([np.log((n + 1) / (counted.get(t, 0) + 1)) + 0.1 for t in range(TERMS)], np.float32)
    idf[PAIRS:] = idf[PAIRS:] + 2  # the few terms of form stand against many pairs
    x, chosen_labels = np.empty((len(rows), TERMS), np.float32), np.array([r["label"] for r in rows], np.float32)
    for at in range(0, len(x), ROWS):  # multiples of 2**-24 up to 1 are exact in 4 bytes
        x[at : at + ROWS] = weighted(np.stack([np.frombuffer(r["counts"], np.float32) for r in rows[at : at + ROWS]]), idf)
    del rows
    projection = directions(x, min(RANK, len(x), TERMS)).astype(np.float32)
    latent = x @ projection
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return {"idf": idf, "projection": projection, "latent": latent.astype(np.float32), "labels": chosen_labels}


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` highest values; of equal ones the first places."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):  # the k-th value comes up again
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


def votes(counts: np.ndarray, model: dict[str, np.ndarray], neighbours: int) -> np.ndarray:
    """The share of label 1 among each row's nearest labelled vectors, weighted by similarity.

    Products are of whole numbers and have no rounding, all else goes number by number, and the votes are added
    in the order of the sample, so that equal texts have equal scores whatever their batch.
    """
    projection, latent = whole(model["projection"], BITS), whole(model["latent"], BITS).T
    out = np.zeros(len(counts))
    for at in range(0, len(counts), ROWS):
        y = unit_rows(np.rint(np.ldexp(whole(weighted(counts[at : at + ROWS], model["idf"]), BITS) @ projection, -BITS)))
        cosine = np.ldexp(y @ latent, -2 * BITS)
        near = np.sort(nearest(cosine, min(neighbours, cosine.shape[1])), axis=1)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6)
        for _ in range(SQUARINGS):
            weight = weight * weight
        one, every = np.zeros(len(near)), np.zeros(len(near))
        for w, label in zip(weight.T, model["labels"][near].T):
            one, every = one + w * label, every + w
        out[at : at + ROWS] = np.clip(one / every, 0, 1)
    return out


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The ``keep`` columns, held_out, score and predicted (1 if score >= 0.3) of each document.

    Scores depend on the text alone, null being empty, and on all of it, however long; of labelled texts that are equally near, those come
    first that the fit's order (a hash of the id) puts first. Labels that repeat for an id are averaged; null
    labels and ids are not learned from. Without labels every score is 0.5. Repeated rows and null ids
    stay as they are; other columns do not matter; an empty table gives no rows.
    """
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in _per_document(batches):
            p = votes(counts, shared.value, neighbours) if shared.value is not None else np.full(len(counts), 0.5)
            yield pa.RecordBatch.from_arrays([*[c for c, name in zip(rows.columns, rows.schema.names) if name != "text"], pa.array(p)], [*[n for n in rows.schema.names if n != "text"], "_score"])

    carried = F.struct(*keep).alias("_row")
    kind = docs.select(carried).schema[0].dataType.simpleString()
    scored = docs.select(carried, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"_row {kind}, _score double")
    return scored.select(*[F.col("_row")[c].alias(c) for c in keep], "_score")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    carried = F.struct(*docs.columns).alias("_row")
    rows = docs.select("doc_id", "text", carried)
    return score(rows, labels, keep=("_row",)).where(F.col("_score") >= THRESHOLD).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
