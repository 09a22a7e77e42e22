"""BPE coding and prefix counts against the library on whole texts."""

import itertools
import random
import time

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD, documents
from tokenizers import Tokenizer

from motionspark.llm import bpe, tokens

HARD = [
    "", " ", "\n\n", "a", "  lead", "tail  ", "it's we've they'll I'm 're 'veal", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z", "1234567 12 3.14", "tab\tand\r\nlines\n \n",
    "naïve café — “quoted”…", "漢字かな混じり文", "🙂🙃 emoji👩‍👩‍👧", "a\x1cb\x85c\xa0d e", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "!!!???...---" * 9, "x" * 70_000, "MiXeD CaSe WORDS", "ÀÉîß, ÿ! Straße_ x__y __ a{b} WORD'S don't. İstanbul ΣΑΣ ſt ﬁn", "\x00nul\x00", "é combining",
]


COUNTER = tokens.PrefixCounter(tokens.tokenizer_path(tokens.VOCABULARY))


def fresh_counter():
    COUNTER.units.clear()
    return COUNTER


def texts():
    draw = random.Random(5)
    letters = "abcdeABC  \n\t'.,!0123éß漢🙂\xa0"
    return HARD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 400))) for _ in range(150)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(tokens.tokenizer_path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(tokens.tokenizer_path(tokens.VOCABULARY))


def whole(library, text):
    library.no_truncation()
    library.no_padding()
    ids = library.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False)


def test_chunk_coder(word_library):
    coder = bpe.ChunkCoder(tokens.tokenizer_path(bpe.VOCABULARY))
    for some in (texts(), texts()[::-1]):  # the second time from the store
        for text, code in zip(some, coder.code(some)):
            assert tuple(code) == whole(word_library, text), repr(text[:80])


def test_chunks_follow_content():
    shared = " ".join(f"word{i}" for i in range(3_000)).encode()
    a = {shared[x:y] for x, y in zip([0, *bpe.cuts(shared)], bpe.cuts(shared))}
    other = b"another start, " + shared
    b = {other[x:y] for x, y in zip([0, *bpe.cuts(other)], bpe.cuts(other))}
    assert b"".join(other[x:y] for x, y in zip([0, *bpe.cuts(other)], bpe.cuts(other))) == other
    assert len(a) > 20 and len(a - b) <= 1


def test_repair_joins_torn_chunks(word_library):
    """Chunks cut within words agree with the whole text once their joins are repaired."""
    coder = bpe.ChunkCoder(tokens.tokenizer_path(bpe.VOCABULARY))
    chunks = [b"some interna", b"tional wor", b"ds stay whole ", b"here"]
    coder.learn(chunks)
    mended = coder.repair(chunks, coder.seams(set(zip(chunks, chunks[1:]))))
    assert " ".join(coder.chunks[c][0] for c in mended) == whole(word_library, b"".join(chunks).decode())[0]


def test_encode_decode_rows(spark, word_library):
    found = bpe.encode_decode(documents(spark, ODD)).collect()
    want = sorted([(i, *whole(word_library, t)) for i, t, _ in ODD], key=repr)
    assert sorted([tuple(r) for r in found], key=repr) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, ids string, n_tokens string")
    assert bpe.encode_decode(docs).columns == ["doc_id", "ids", "n_tokens", "decoded"]
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, keep=("doc_id", "ids"))


def test_store_stays_bounded(word_library, monkeypatch):
    """A store that is full starts afresh, and results stay the library's."""
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5_000)
    monkeypatch.setattr(bpe, "KEPT_WORD_BYTES", 5_000)
    coder = bpe.ChunkCoder(tokens.tokenizer_path(bpe.VOCABULARY))
    draw = random.Random(8)
    for _ in range(12):
        text = " ".join("".join(draw.choice("abcdé") for _ in range(draw.randint(1, 90))) for _ in range(60))
        assert tuple(coder.code([text])[0]) == whole(word_library, text)
        assert coder.chunk_bytes < 40_000 and coder.word_bytes < 40_000


def test_every_document(spark, word_library, byte_library):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, SMALL).collect():
        ids, n, decoded = whole(word_library, text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(decoded))
    rows = tokens.op8_tokens(spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = whole(byte_library, text[r.doc_id])[1]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text[r.doc_id] or "").encode()), n, n > 512)


def prefix_counts(table):
    return [0, *itertools.accumulate(b - 256 if b > 127 else b for b in table)]


def test_prefix_tables(byte_library):
    """Every prefix of whole characters has the library's count."""
    counter = tokens.PrefixCounter(tokens.tokenizer_path(tokens.VOCABULARY))
    short = [t[:60] for t in texts()]
    for text, table in zip(short, counter.prefix_tables(short)):
        assert len(table) == len(text.encode())
        counts = prefix_counts(table)
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(byte_library.encode(text[:i], add_special_tokens=False)), repr((text, i))


PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\0", "'", "'re", "'l", "'ll", "'s", "they", "!", "...", "<|endoftext|>", "<|endof", "text|>", "9", "漢字", "かな", "é", "e\u0301", "🙂", "AbC", "\u200b", "\ufeff"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_any_prefix(byte_library, text):
    """Also within white space of every kind, contractions and special strings."""
    counts = prefix_counts(COUNTER.prefix_tables([text])[0])
    for i in range(len(text) + 1):
        assert counts[len(text[:i].encode())] == len(byte_library.encode(text[:i], add_special_tokens=False))


@pytest.mark.parametrize("make", [lambda n: "日本語の文章。\n\n" * (n // 9), lambda n: " " * n, lambda n: "x " + "\n" * n + " y", lambda n: "漢" * n, lambda n: "<|endoftext|> \n" * (n // 15)], ids=["blank-lines", "spaces", "newlines", "one-word", "special"])
def test_time_grows_with_length(byte_library, make):
    """Four times the length takes far less than sixteen times as long, and the counts are the library's."""
    took = []
    for n in (4_000, 8_000, 16_000):
        text, start = make(n), time.process_time()
        table = tokens.PrefixCounter.prefix_tables(fresh_counter(), [text])[0]
        took.append(time.process_time() - start)
        assert prefix_counts(table)[-1] == len(byte_library.encode(text, add_special_tokens=False))
        some = len(text) // 2
        assert prefix_counts(table)[len(text[:some].encode())] == len(byte_library.encode(text[:some], add_special_tokens=False))
    assert took[2] < 8 * took[0] + 0.2 and took[2] < 3


def test_totals(byte_library):
    counter = tokens.PrefixCounter(tokens.tokenizer_path(tokens.VOCABULARY))
    some = texts()
    for text, table in zip(some, counter.prefix_tables(some)):
        assert sum(b - 256 if b > 127 else b for b in table) == whole(byte_library, text)[1], repr(text[:80])


def test_prefix_columns(spark, byte_library):
    import pyspark.sql.functions as F

    text = "Counting tokens of prefixes, without encoding anything again."
    df = tokens.token_prefixes(documents(spark, [(1, text, "s"), (2, None, "s")]))
    row = df.where("doc_id = 1").select(tokens.tokens_of_prefix(F.col("prefix_table"), F.lit(15)).alias("n"), tokens.longest_prefix(F.col("prefix_table"), F.lit(4)).alias("b")).first()
    assert row.n == whole(byte_library, text[:15])[1]
    assert whole(byte_library, text[: row.b])[1] <= 4 < whole(byte_library, text[: row.b + 1])[1]
    assert tuple(df.where("doc_id = 2").select("n_bytes", "n_tokens").first()) == (0, 0)


def test_odd_rows(spark, byte_library):
    found = tokens.token_prefixes(documents(spark, ODD)).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(i, len((t or "").encode()), whole(byte_library, t)[1]) for i, t, _ in ODD], key=repr)


def unspaced(kind, n):
    draw = random.Random(n)
    ideograph = lambda: chr(draw.randrange(0x4E00, 0x9FA0))
    each = {
        "ideographs": ideograph,
        "sentences": lambda: ideograph() if draw.random() < 0.9 else draw.choice("。、"),
        "letters": lambda: draw.choice("abcdefghijklmnopqrstuvwxyz"),
        "letters-digits": lambda: draw.choice("abcdefghijklmnopqrstuvwxyz0123456789"),
        "marks": lambda: draw.choice(["'", "'s", "!", "<|", "<|endoftext|>", "é", "1", "|>", "é", "x"]),
    }[kind]
    return "".join(each() for _ in range(n))


@pytest.mark.parametrize("kind", ["ideographs", "sentences", "letters", "letters-digits", "marks"])
def test_time_grows_with_length_without_spaces(word_library, kind):
    """Texts without white space take time in proportion to their length; ids and decoded text are the library's."""
    took = []
    for n in (100_000, 200_000, 400_000):
        text, coder = unspaced(kind, n), bpe.ChunkCoder(tokens.tokenizer_path(bpe.VOCABULARY))
        start = time.process_time()
        code = coder.code([text])[0]
        took.append(time.process_time() - start)
        assert tuple(code) == whole(word_library, text)
    assert took[2] < 8 * took[0] + 0.2 and took[2] < 10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "。", "、", "a1", "(", "|", "x's"]), max_size=40).map("".join))
def test_limits_of_pieces(word_library, text):
    """Before every limit a text falls into two that are encoded apart, away from added tokens."""
    data = text.replace("<|endof", "").replace("text|>", "").encode()
    can = np.flatnonzero(bpe.limits(np.frombuffer(data, np.uint8)))
    encode = lambda b: word_library.encode(b.decode(), add_special_tokens=False).ids
    for cut in can.tolist():
        assert encode(data[:cut]) + encode(data[cut:]) == encode(data)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.ChunkCoder(tokens.tokenizer_path(tokens.VOCABULARY))
