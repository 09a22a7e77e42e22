import zlib

import numpy as np
from llm_cases import ODD, documents
from pyspark.sql import functions as F

from motionspark.llm import quality

FOLDER = "/root/testdata/sf0.01"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, FOLDER).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y, s, p = (np.array(v, float) for v in zip(*held))
    assert auc(y, s) >= 0.9
    assert (p == y).mean() >= 0.85


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: {r.doc_id: r["_score"] for r in quality.score(docs, x).collect()}
    assert scores(labels) == scores(turned)


def test_votes_are_exact_cosines():
    draw = np.random.default_rng(2)
    counts = quality.term_counts([bytes(draw.integers(97, 110, 200, dtype=np.uint8)) for _ in range(50)])
    idf = np.ones(quality.TERMS, np.float32)
    x = quality.weighted(counts, idf)
    projection = quality.directions(x, 12)
    latent = x @ projection
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    labels = (draw.random(50) < 0.5).astype(np.float32)
    model = {"idf": idf, "projection": projection, "latent": latent, "labels": labels}
    found = quality.votes(counts, model, 5)
    for i in range(50):
        cosine = latent @ latent[i]
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 1e-6).astype(float) ** quality.SHARPNESS
        assert abs(found[i] - (weight * labels[near]).sum() / weight.sum()) < 1e-4


def test_ties_take_the_first(spark):
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.3, 0.3, 0.3, 0.3, 0.3]], np.float32)
    assert [sorted(r) for r in quality.nearest(cosine, 2).tolist()] == [[0, 1], [0, 1]]


def test_equal_texts_have_equal_scores():
    """Whatever rows stand about them in a batch."""
    draw = np.random.default_rng(4)
    counts = quality.term_counts([bytes(draw.integers(97, 123, 300, dtype=np.uint8)) for _ in range(700)])
    model = {"idf": np.ones(quality.TERMS, np.float32), "projection": quality.directions(quality.weighted(counts, np.ones(quality.TERMS, np.float32)), 16)}
    latent = quality.weighted(counts[:200], model["idf"]) @ model["projection"]
    model |= {"latent": latent / np.linalg.norm(latent, axis=1, keepdims=True), "labels": (draw.random(200) < 0.5).astype(np.float32)}
    whole = quality.votes(counts, model, 25)
    for at in (1, 3, 100, 511, 600):
        assert (quality.votes(counts[at : at + 1], model, 25) == whole[at : at + 1]).all()
        assert (quality.votes(counts[at:], model, 25) == whole[at:]).all()


def test_term_counts_and_idf(spark):
    """Against plain counting; a document has a term or not, however often."""
    texts = [b"", b"ab ab cd", "é 1A!\n".encode()]
    counts = quality.term_counts(texts)
    for row, text in zip(counts, texts):
        slots = np.zeros(quality.PAIRS)
        for a, b in zip(text, text[1:]):
            slots[quality._slots[a * 256 + b]] += 1
        assert np.allclose(row[: quality.PAIRS], slots / max(len(text) - 1, 1))
    form = counts[1][quality.PAIRS :]
    assert np.allclose(form, [0, 0, 0, 0, 1 / 3, 1 / 3, 3 / 8, 0]) and counts[0][-1] == 1 and counts[0].sum() == 1
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int"))
    want = np.log(4 / ((counts > 0).sum(axis=0) + 1)) + 0.1
    want[quality.PAIRS :] += 2
    assert np.allclose(model["idf"], want)


def test_odd_documents(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["_score"] <= 1 for r in rows)
    none = quality.score(docs, labels.limit(0)).collect()
    assert {r["_score"] for r in none} == {0.5}
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns
    assert quality.accepted(docs, labels.limit(0)).count() == len(ODD)


def test_one_row_has_one_score_in_every_place():
    """Also with weights and sizes of all magnitudes, and as a row of its own."""
    draw = np.random.default_rng(6)
    texts = [bytes(draw.integers(32, 32 + draw.integers(2, 90), draw.integers(0, 900), dtype=np.uint8)) for _ in range(quality.ROWS)]
    counts, idf = quality.term_counts(texts), (0.1 + 20 * draw.random(quality.TERMS)).astype(np.float32)
    x = quality.weighted(counts, idf)
    projection = quality.directions(x, 24).astype(np.float32)
    model = {"idf": idf, "projection": projection, "latent": (x @ projection).astype(np.float32), "labels": (draw.random(len(x)) < 0.3).astype(np.float32)}
    model["latent"] /= np.maximum(np.linalg.norm(model["latent"], axis=1, keepdims=True), 1e-12)
    found = {quality.votes(counts[77:78], model, 25)[0]}
    for at in range(0, quality.ROWS, 5):
        found.add(quality.votes(np.roll(counts, at - 77, axis=0), model, 25)[at])
    assert len(found) == 1
