"""From raw documents to token ids: reject, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionspark.llm import bpe, mixing, neardup, quality, secrets
from motionspark.llm.common import staged, table


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, rejects go.

    Null texts count as empty ones; repeated rows and null ids are judged by their texts alone, so copies stay or go
    together; without usable labels nothing goes; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more.

    The smallest id stays, null ids last, and of equal ids the text of the least hash. Texts without words are
    near nothing and stay, but rows alike in id and text are one. Ids do not link texts. An empty table stays empty.
    """
    return neardup.without_near_duplicates(docs, words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks.

    No row goes; null and empty texts stay as they are; n_chars follows the text; a text that repeats is scanned once.
    """
    return secrets.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents repeat for each epoch that takes them.

    Null is a source of its own. Texts stay whole, so a source meets its target within half a document; texts
    without words are taken by no cut and go; a source with a target keeps one document at least. Ties and repeated
    rows fall by a hash of the id, the same on every run. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (decimal, joined by one space) and n_tokens of every document.

    Null texts are empty and have no ids; very long ones are coded whole; repeated rows and null ids stay.
    """
    return bpe.encode_decode(docs, lambda code: code[:2], "ids string, n_tokens long", keep=("doc_id", "lang", "source"))


STAGES = [("quality", reject), ("near_dedup", deduplicate), ("secrets", redact), ("mixing", mix), ("bpe", encode)]

#: Similarity voting and BPE are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
