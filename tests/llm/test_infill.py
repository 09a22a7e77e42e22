import hashlib
import random
import re

import pytest
from llm_cases import ODD, documents

from motionspark.llm import infill

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
HARD = ["", "a", " ", "\n", "ab" * 400, "é🙂\U00010000x" * 100, "a1b22\nc" * 300, " " * 700, "A" * 128 + "!", "!" * 127 + "ab", "x<P>y", "tail <", "<S", "M> <M", "<S" * 90, "\r\n" * 100, "z" * 256, "Öab" * 128]


def plainly(doc_id, text):
    """The same by hand: prefix, middle, suffix, n, form, output."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = SHA("1:" + ("" if doc_id is None else str(doc_id)))
    a, b, c, d = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    p, q = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if not text or any(m in text for m in infill.MARKS) or c % 100 >= 90:
        return None, None, None, n, "plain", text
    if d % 100 < 20:
        return prefix, middle, suffix, n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    return prefix, middle, suffix, n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted(((r.doc_id, r.prefix, r.middle, r.suffix, r.n, r.form, r.output) for r in df.collect()), key=repr)


def test_against_plain_cutting(spark):
    draw = random.Random(3)
    pieces = ["word", "A", " ", "\n", "1", "é", "漢", "🙂", "<", "S>", "<P", "zZz"]
    texts = HARD + ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 500))) for _ in range(150)]
    rows = [(i, t, "web") for i, t in enumerate(texts)] + ODD
    want = sorted(((i, *plainly(i, t)) for i, t, _ in rows), key=repr)
    assert rows_of(infill.fill_in_middle(documents(spark, rows))) == want


def test_restored_from_output_and_form_alone(spark):
    rows = [(i, t, "web") for i in range(0, 4000, len(HARD)) for i, t in enumerate(HARD, i)]
    made = infill.fill_in_middle(documents(spark, rows), keep=("doc_id", "text"))
    found = made.select("text", "form", infill.restored(made["output"], made["form"]).alias("again")).collect()
    assert all(r.text == r.again for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}


def test_other_lengths_of_pieces(spark, monkeypatch):
    """The length of pieces does not matter to the result."""
    docs = documents(spark, [(i, t, "web") for i, t in enumerate(HARD)])
    want = rows_of(infill.fill_in_middle(docs))
    for size in (1, 7, 1000):
        monkeypatch.setattr(infill, "PIECE", size)
        assert rows_of(infill.fill_in_middle(docs)) == want


def test_columns_and_empty_table(spark):
    docs = documents(spark, [(1, "a b c", "web")])
    kept = infill.fill_in_middle(docs, keep=("doc_id", "row", "key", "kept"))
    assert kept.columns == ["doc_id", "row", "key", "kept", "n", "form", "prefix", "middle", "suffix", "output"] and kept.first().key == "x"
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs.withColumnRenamed("kept", "n"), keep=("doc_id", "n"))


def test_texts_are_shuffled_once(spark):
    plan = infill.op13_infill(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == plan.count("Exchange hashpartitioning") and plan.count("Exchange hashpartitioning") == 2
    first, second = [line.split("Exchange")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert first.split("plan_id")[0].count(",") == second.split("plan_id")[0].count(",")  # the same columns, so the one is reused
