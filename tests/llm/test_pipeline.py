"""The stages of the corpus pipeline, each held against a plain version of what it should do."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SMALL
from llm_cases import ODD, near_components
from test_secrets import brute as brute_spans
from tokenizers import Tokenizer

from motionspark.llm import quality
from motionspark.llm.mixing import mix
from motionspark.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """documents and the rows each stage keeps, written and read again between stages."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], SMALL).write.parquet(f"{folder}/{k}")
        docs.append(spark.read.parquet(f"{folder}/{k}"))
    return docs


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "bpe"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality_rejects(spark, stages):
    scores = {r.doc_id: r["_score"] for r in quality.score(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")).collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_one_of_each_near_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, (_, c) in near_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == want


def test_secrets_go(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert not brute_spans(text)
        assert (text == before[i]) == (not brute_spans(before[i]))


def test_mix_repeats(stages):
    taken = {r.doc_id: int(r.taken / max(r.size, 1) + 0.5) for r in mix(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: n for i, n in taken.items() if n})


def test_ids_are_the_library_s(stages):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(tuple, stages[-1].collect()))


def folder_of(spark, folder, rows, labels):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, empty and long texts and repeated rows pass through every stage."""
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    folder = folder_of(spark, tmp_path / "odd", ODD, [(1, 1, 0), (None, 0, 0), (7, None, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        assert k == 4 or after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = docs.collect()
    known = {" ".join(map(str, library.encode(t or "", add_special_tokens=False).ids)) for _, t, _ in ODD}
    assert rows and {r.ids for r in rows} <= known


def test_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "none", [], [])).count() == 0
