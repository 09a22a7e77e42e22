"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed. A blob is scanned once for each rule version: blobs
that the ledger already holds under the current rule version are skipped, copies are scanned once, and
findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

#: The three base rules, with the group whose length is tested and its least length.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
RULE_VERSION = "base-1"

SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed.

    A match that is too short is dropped after it has been matched, so it still hides what it covers.
    Runs of hex digits are maximal, so asking the pattern for 32 or more finds the same runs.
    """
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, kind)], ["blob", "spans"])


def address(versions: DataFrame, path: str, text: str) -> DataFrame:
    """path, blob, text: the blob is the SHA-256 of the text in UTF-8; a null text is the empty blob."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


def scan_unseen(addressed: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs that ``ledger`` lacks at this rule version."""
    blobs = addressed.groupBy("blob").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return blobs.mapInArrow(_scan, f"blob string, spans {SPANS}").select("blob", F.lit(rule_version).alias("rule_version"), "spans")


LEDGER = f"blob string, rule_version string, spans {SPANS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept ledger, None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings (path, blob, spans) for every row of ``versions``; the ledger at ``ledger_path`` grows by what it lacked.

    The ledger is a Parquet table. Blobs that it holds under this rule version are not scanned; the others
    are scanned once and appended, in one commit, before the findings are joined back from it; a run that fails
    leaves the ledger as it was. One run at a time writes a ledger. Defined cases: null text is scanned as
    empty; a null path is a path like any other; repeated rows each get the findings of their blob; other
    columns are ignored; an empty table gives no rows; a very long text is scanned whole, within one task.
    """
    addressed = address(versions, path, text)
    scan_unseen(addressed, read_ledger(versions.sparkSession, ledger_path), rule_version).write.mode("append").parquet(ledger_path)
    known = read_ledger(versions.sparkSession, ledger_path).where(F.col("rule_version") == rule_version).select("blob", "spans")
    return addressed.select("path", "blob").join(known, "blob")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Base rules are the whole rule set, so all spans are the base spans."""
    found = scan_versions(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    listed = joined_spans(F.col("spans"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *[n(k) for k in KINDS], F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans")
    )


def base_digest(text: str | None) -> str:
    """The digest of one text's base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in find_spans(text)).encode()).hexdigest()


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by the kind of its first span."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for kind, start, stop in spans:  # by start
        if start >= end:
            out += (text[at if end < 0 else end : start], f"[{kind}]")
            at = end = stop
        else:
            end = max(end, stop)
    return "".join([*out, text[end:]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced by marks; texts without any stay as they are.

    ``n_chars``, if there is such a column, follows the text.
    """
    columns = docs.columns
    found = scan_versions(docs.select(F.struct(*columns).alias("_row"), "text"), fresh_path(docs.sparkSession, "ledger"), path="_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = batch.column("path"), batch.column("spans").to_pylist()
            texts = [redacted(t, [(s["kind"], s["start"], s["end"]) for s in ss]) for t, ss in zip(row.field("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], ["path", "_text"])

    kind = dict(found.dtypes)["path"]
    cleaned = found.select("path", "spans").mapInArrow(run, f"path {kind}, _text string")
    own = {"text": F.col("_text"), "n_chars": F.when(F.col("path.text") == F.col("_text"), F.col("path.n_chars")).otherwise(F.length("_text").cast("long"))} if "n_chars" in columns else {"text": F.col("_text")}
    return cleaned.select(*[own.get(c, F.col("path")[c]).alias(c) for c in columns])
