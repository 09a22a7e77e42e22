"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks whose limits depend on content alone, so a
passage that documents share gives the same chunks in each of them. A chunk is encoded once and its
ids and decoded text are reused wherever it comes up again; the words of a new chunk are looked up in
the same way before the library encodes what is left. Then the joins are repaired: the characters about
each join, out to the ends of the words there, are encoded again as one text. Where that disagrees with
the two sides, the chunks become one that is encoded anew, until every join agrees. Text without white space is cut where
the vocabulary's pattern starts a new piece, so that work stays in proportion to a text's length.

The store is held by each Python worker and bounded. Sharing it between executors would send every
chunk's text through one shuffle and its ids back through another, which is more than the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import table
from .tokens import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
WINDOW = 16
#: A cut falls on one in MASK + 1 of the white space bytes.
MASK = 127
#: Chunks of more bytes than this are cut at limits of the vocabulary's pieces, where they have any.
LONGEST = 65_536
#: Bytes on either side of a join that are compared at least; more than an added token has.
NEAR = 64
#: Bytes that a worker's kept chunks and kept words may take (by estimate); when full it starts afresh.
KEPT_BYTES = 64_000_000
KEPT_WORD_BYTES = 150_000_000
ENTRY_BYTES = 300  # of a kept entry beside its texts
LONGEST_WORD = 64  # characters of a word that is kept
BATCH_ROWS = 500

#: White space that Python's split takes but the tokenizer's patterns may not.
_odd = re.compile(r"[\x1c-\x1f\x85]")
#: Words of plain letters with plain marks behind: the vocabulary's pattern takes the two apart and lower-cases the letters.
_plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: What an added token must not hold, so that no limit of pieces falls within one.
_limited = re.compile(r"[\s0-9]|[A-Za-z][!-/:-@\[-`{}~]")
#: Fixed values of the vocabulary's format: its normalizers, and its pattern of pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_SPACES = b" \t\n\v\f\r"
_EACH = [bytes([b]) for b in _SPACES]
_factors = np.random.default_rng(7).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)

Encoded = tuple[str, int, str]  # decimal ids joined by one space, their number, decoded text


def limits(raw: np.ndarray) -> np.ndarray:
    """Places before which the vocabulary's pattern always starts a new piece, whatever stands further off.

    Before an ASCII digit; before an ASCII mark behind an ASCII letter or digit (but a bar, which added tokens
    hold); before an ideographic comma or full stop behind an ideograph.
    """
    out = (raw >= 48) & (raw <= 57)
    word = out | (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122)
    mark = (raw >= 33) & (raw <= 126) & ~word & (raw != 124)
    out[1:] |= mark[1:] & word[:-1]
    if len(raw) > 5:
        stop = (raw[3:-2] == 0xE3) & (raw[4:-1] == 0x80) & ((raw[5:] == 0x81) | (raw[5:] == 0x82))
        out[3:-2] |= stop & (raw[:-5] >= 0xE5) & (raw[:-5] <= 0xE9)
    return out


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``, the last one its length.

    Cuts fall behind white space; a stretch of over LONGEST bytes without one is cut at limits of pieces, by the same
    hash where it can be and after LONGEST bytes where not. What has no limit, such as one run of letters, stays whole.
    """
    raw = np.frombuffer(data, np.uint8)
    sums, width = _factors[raw], 1
    while width < WINDOW:  # hashes of 2, 4, 8, 16 bytes ending at each place
        shifted = np.zeros_like(sums)
        shifted[width:] = sums[:-width] if width < len(sums) else 0
        sums = sums + shifted * np.uint32(pow(0x9E3779B1, width, 2**32))
        width *= 2
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    mixed = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    chosen = (mixed >> np.uint32(9)) & np.uint32(MASK) == 0
    out, at = [], 0
    for end in [*(np.flatnonzero(space & chosen) + 1).tolist(), len(data)]:
        if end - at > LONGEST:
            can = at + 1 + np.flatnonzero(limits(raw[at:end])[1:])
            for cut in can[chosen[can - 1]].tolist():
                out += _spaced(can, at, cut)
                out.append(cut)
                at = cut
            out += _spaced(can, at, end)
        if end > at:
            out.append(end)
            at = end
    return out


def _spaced(can: np.ndarray, at: int, end: int) -> list[int]:
    """Of the places that can be cut, those next after every LONGEST bytes from ``at`` on, before ``end``."""
    out = []
    while end - at > LONGEST and (i := int(np.searchsorted(can, at + LONGEST))) < len(can) and can[i] < end:
        at = int(can[i])
        out.append(at)
    return out


class ChunkCoder:
    """Encodes and decodes whole texts through a store of chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks: dict[bytes, Encoded] = {}
        self.ids: dict[str, str] = {}  # of words
        self.read: dict[str, str] = {}
        self.chunk_bytes = self.word_bytes = 0
        whole = json.loads(self.library.to_str())
        steps = [(whole["normalizer"] or {}).get("normalizers"), (whole["pre_tokenizer"] or {}).get("pretokenizers")]
        added = self.library.get_added_tokens_decoder().values()
        odd = any(t.normalized or t.lstrip or t.rstrip or t.single_word or len(t.content.encode()) > NEAR or _limited.search(t.content) for t in added)
        if steps != [NORMALIZERS, PIECES] or whole["decoder"] is not None or odd:
            raise ValueError("the coder knows the vocabulary's own normalizer and pattern, no decoder, and added tokens without digits, white space or flags")
        self.token = {i: t for t, i in self.library.get_vocab().items()}  # without a decoder they are joined by spaces
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}  # the format's fixed map of bytes to letters
        self.letters = str.maketrans({chr(c): "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)})
        self.number = {i: str(i) for i in self.token}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece as the pattern takes it: normalized letters or marks, in the model's letters for their bytes."""
        return [t.id for t in self.library.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]

    def _whole(self, text: str) -> bool:
        """Whether the library alone has to encode this chunk: its words may not stand for themselves."""
        return _odd.search(text) is not None or any(s in text for s in self.special)

    def learn(self, new: list[bytes]) -> None:
        """Encode chunks that the store lacks."""
        texts = [c.decode() for c in new]
        split = [[t] if self._whole(t) else t.split() for t in texts]
        found = [list(map(self.ids.get, words)) for words in split]
        lacking = {w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None}
        parts = {w: (m[1].lower(), m[2]) if (m := _plain.fullmatch(w)) else (w,) for w in lacking}
        apart = list({p for ps in parts.values() if len(ps) == 2 for p in ps if p}.difference(self.ids))
        mixed = [w for w, ps in parts.items() if len(ps) == 1]
        for part, ids in zip([*apart, *mixed], [*map(self._piece, apart), *self._encode(mixed)]):
            self.ids[part], self.read[part] = " ".join(map(self.number.__getitem__, ids)), " ".join(map(self.token.__getitem__, ids))
        for word, ps in parts.items():
            if len(ps) == 2:
                self.ids[word], self.read[word] = (f"{x[ps[0]]} {x[ps[1]]}" if ps[1] else x[ps[0]] for x in (self.ids, self.read))
        for chunk, words in zip(new, split):
            ids = " ".join(filter(None, map(self.ids.__getitem__, words)))
            read = " ".join(filter(None, map(self.read.__getitem__, words)))
            self.chunks[chunk] = ids, ids.count(" ") + bool(ids), read
            self.chunk_bytes += ENTRY_BYTES + len(chunk) + len(ids) + len(read)
        for word in lacking.union(apart):
            if len(word) > LONGEST_WORD:
                del self.ids[word], self.read[word]
            else:
                self.word_bytes += ENTRY_BYTES + 2 * len(word)

    def seams(self, pairs: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """Those of the joins at which the two sides' ids are not those of the text across the join."""
        near = {pair: (_last_word(pair[0]), _first_word(pair[1])) for pair in pairs}
        known = {x: self.ids[x.strip()] for ab in near.values() for x in ab if x.strip() in self.ids}
        new = list({x for a, b in near.values() for x in (a, b, a + b)} - known.keys())
        known.update(zip(new, (" ".join(map(str, ids)) for ids in self._encode(new))))
        return {pair for pair, (a, b) in near.items() if " ".join(filter(None, (known[a], known[b]))) != known[a + b]}

    def repair(self, chunks: list[bytes], torn: set[tuple[bytes, bytes]]) -> list[bytes]:
        """Chunks whose codes agree at every join: those that do not are put together and encoded anew.

        All that hangs together by torn joins is joined at once; only the joins of what was joined are looked at again.
        """
        while torn:
            parts = [[chunks[0]]]
            for pair in zip(chunks, chunks[1:]):
                if pair in torn:
                    parts[-1].append(pair[1])
                else:
                    parts.append([pair[1]])
            out = [b"".join(p) for p in parts]
            fresh = [len(p) > 1 for p in parts]
            self.learn(list({c for c, new in zip(out, fresh) if new}.difference(self.chunks)))
            torn = self.seams({(a, b) for a, b, x, y in zip(out, out[1:], fresh, fresh[1:]) if x or y})
            chunks = out
        return chunks

    def code(self, texts: list[str | None]) -> list[Encoded]:
        """Ids and decoded text of each whole text; null is empty."""
        if self.chunk_bytes > KEPT_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        if self.word_bytes > KEPT_WORD_BYTES:
            self.ids.clear()
            self.read.clear()
            self.word_bytes = 0
        split = []
        for text in texts:
            data = (text or "").encode()
            ends = cuts(data)
            split.append([data[a:b] for a, b in zip([0, *ends], ends)])
        self.learn(list({c for chunks in split for c in chunks}.difference(self.chunks)))
        torn = self.seams({pair for chunks in split for pair in zip(chunks, chunks[1:])})
        if torn:
            split = [self.repair(chunks, torn) for chunks in split]
        coded = [[code for c in chunks if (code := self.chunks[c])[1]] for chunks in split]
        return [(" ".join([c[0] for c in codes]), sum([c[1] for c in codes]), " ".join([c[2] for c in codes])) for codes in coded]


def _last_word(chunk: bytes) -> str:
    """The last word of a chunk with the white space behind it; of a long word what follows a limit of pieces."""
    body = chunk.rstrip(_SPACES)
    word = chunk[max(body.rfind(c) for c in _EACH) + 1 :]
    if len(word) > 2 * NEAR:
        can = np.flatnonzero(limits(np.frombuffer(word, np.uint8))[:-NEAR])
        word = word[int(can[-1]) :] if len(can) else word
    return word.decode()


def _first_word(chunk: bytes) -> str:
    """The first word of a chunk with the white space before it; of a long word what goes before a limit of pieces."""
    start = len(chunk) - len(chunk.lstrip(_SPACES))
    word = chunk[: min((i for c in _EACH if (i := chunk.find(c, start)) >= 0), default=len(chunk))]
    if len(word) > 2 * NEAR:
        can = NEAR + np.flatnonzero(limits(np.frombuffer(word, np.uint8))[NEAR:])
        word = word[: int(can[0])] if len(can) else word
    return word.decode()


@lru_cache(maxsize=4)
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def encode_decode(
    docs: DataFrame,
    derive: Callable[[Encoded], tuple] | None = None,
    columns: str = "ids string, n_tokens long, decoded string",
    vocabulary: str = VOCABULARY,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and decode it again: the ``keep`` columns and ids, n_tokens, decoded.

    ``ids`` are decimal and joined by one space; ``decoded`` is the library's decoding of them with
    special tokens kept. ``vocabulary`` has the normalizer and pattern of VOCABULARY (ValueError in the task if not). ``derive`` makes other ``columns`` (a DDL string of longs and strings) from
    (ids, n_tokens, decoded), so that what is not wanted need not leave the task. Null text is empty; a very
    long text is a batch of its own; repeated rows and null ids stay as they are; columns that are not kept do
    not matter, and a kept one named like a column made here is refused (ValueError); an empty table gives no rows.
    """
    path = tokenizer_path(vocabulary)
    names = [c.split()[0] for c in columns.split(",")]
    if clashing := set(keep) & {*names, "_encoded_text"}:
        raise ValueError(f"kept columns named like new ones: {sorted(clashing)}")
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in columns.split(",")]
    make = derive or tuple

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = coder(path)
        for batch in batches:
            for a, b, texts in wh.batches(batch, "_encoded_text", BATCH_ROWS):
                rows = batch.slice(a, b - a)
                made = [make(code) for code in chunks.code([t.decode() for t in texts])]
                values = [pa.array(v, kind) for v, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *values], [*keep, *names])

    kinds_kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, F.col(text_col).alias("_encoded_text")).mapInArrow(run, ", ".join([*kinds_kept, columns]))


def digests(code: Encoded) -> tuple:
    ids, n, text = code
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
