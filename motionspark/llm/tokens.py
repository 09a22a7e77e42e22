"""Exact token counts at every prefix of a text, for byte-level BPE.

A prefix dynamic programme stores, for each byte of a text, how the token count changes when that byte
is added: one signed byte each. Sums of this table answer how many tokens a prefix has and how much of
a text a budget holds, without encoding anything again.

The programme runs on units, a stretch of white space and what follows up to the next: the tokenizer never
joins across their limits. For a piece of a unit, the encoding of its prefix of length i is that of a
shorter prefix followed by one token, and exactly one choice is stable: the one whose last two tokens stay
apart when they are encoded together. Where the pieces of a prefix are not those of the whole (within white
space, a contraction or a special string) the table follows the prefix's own pieces; each of them is
worked out once, so the work grows with the length of the text. Short units are kept and their tables
reused, up to a bound in bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import wordhash as wh
from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: Bytes that a worker's kept tables may take (by estimate); when full it starts afresh.
KEPT_BYTES = 96_000_000
ENTRY_BYTES = 220  # of a kept unit beside its text and table
LONGEST_KEPT = 64  # characters of a unit that is kept

BATCH_ROWS = 1_000
#: The white space of the pattern, and the contractions that take two letters.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = ("'re", "'ve", "'ll")
_unit = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_run = re.compile(f"[{_WS}]+")
_odd = re.compile("[\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]|  | $")
#: Units of the common form: a word of plain letters with or without a space before and marks behind.
_plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|-]*)")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is returned as it is."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class PrefixCounter:
    """Prefix tables for one byte-level BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in printable]
        #: The format's fixed map of bytes to characters: printable ones stand for themselves, others from 256 on.
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}
        byte = {c: b for b, c in self.letter.items()}
        added = list(self.library.get_added_tokens_decoder().values())
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        whole = json.loads(self.library.to_str())
        split = whole["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and whole["normalizer"] is None
        if not plain or any(t.lstrip or t.rstrip or t.single_word or _run.search(t.content) for t in added) or any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError("the programme knows byte-level vocabularies without normalizer, prefix space, or stripping, spaced or nested added tokens")
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.ids = {bytes(byte[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        #: Every ending of a token, with the token's id where it is one.
        self.endings = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        model = whole["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = [tuple(bytes(byte[c] for c in x) for x in m) for m in pairs]
        self.rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(parts)}
        self.text = {i: t for t, i in self.ids.items()}
        made: dict[int, tuple[int, int]] = {}
        for a, b in parts:
            made.setdefault(self.ids[a + b], (self.ids[a], self.ids[b]))
        self.right_edge = {t: self._edge(t, made, 1) for t in self.text}
        self.left_edge = {t: self._edge(t, made, 0) for t in self.text}
        self._text, self._last, self._count = b"", [-1], [0]
        self._marks: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.held = 0  # bytes of the kept units
        self.apart: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, made: dict[int, tuple[int, int]], side: int) -> list[tuple[int, int, int]]:
        """The parts that stand at one edge of a token while it is merged: (part, rank it is made at, rank it is taken at)."""
        out, taken = [], len(self.rank) + 1
        while True:
            rank = self.rank[made[token]] if token in made else -1
            out.append((token, rank, taken))
            if token not in made:
                return out
            token, taken = made[token][side], rank

    def merge(self, text: bytes) -> list[int]:
        """Plain BPE: join the pair of least rank, leftmost first, until none is left."""
        parts = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:]))), default=None)
            if best[0] == len(self.rank):
                break
            i = best[1]
            parts[i : i + 2] = [self.ids[self.text[parts[i]] + self.text[parts[i + 1]]]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay apart when their bytes are encoded together.

        They do not if two parts that stand at the seam at the same time form a pair of less rank than
        the merges that would take either of them; of equal ranks the leftmost pair comes first.
        """
        kept = self.apart.get((left, right))
        if kept is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            rank, none = self.rank.get, len(self.rank) + 2
            kept = not any(
                made_a < taken_b and made_b < taken_a and (r := rank((a, b), none)) < taken_a and r <= taken_b
                for a, made_a, taken_a in self.right_edge[left]
                for b, made_b, taken_b in self.left_edge[right]
            )
            self.apart[left, right] = kept
        return kept

    def counts(self, text: bytes) -> list[int]:
        """Token counts of all prefixes of a piece, from none to all of its bytes; the list is valid until the next call.

        What the piece shares with the one before it is not worked out again: units come sorted.
        """
        before, last, count = self._text, self._last, self._count
        same = len(text) if before.startswith(text) else next((i for i, (x, y) in enumerate(zip(text, before)) if x != y), min(len(text), len(before)))
        del last[same + 1 :], count[same + 1 :]
        ending, apart = self.endings.get, self.apart.get
        for end in range(same + 1, len(text) + 1):
            for start in range(end - 1, -1, -1):
                token = ending(text[start:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte")
                if token >= 0 and (start == 0 or (apart((last[start], token)) or self.stable(last[start], token))):
                    break
            last.append(token)
            count.append(count[start] + 1)
        self._text = text
        return count

    def piece(self, text: bytes) -> list[int]:
        """Change of the token count at each byte of a piece."""
        count = self.counts(text)
        return [y - x & 255 for x, y in zip(count, count[1:])]

    def marks(self, text: str) -> bytes:
        """The table of a piece of marks; few are in use, and they leave the state for words alone."""
        if (kept := self._marks.get(text)) is None:
            state, self._text, self._last, self._count = (self._text, self._last, self._count), b"", [-1], [0]
            kept = bytes(self.piece(text.encode()))
            self._text, self._last, self._count = state
            if len(self._marks) < 10_000:
                self._marks[text] = kept
        return kept

    def walk(self, text: str) -> bytes:
        """The table of a text without special strings, piece by piece of the library's pattern.

        White space that ends a prefix is one piece, however the whole text parts it.
        """
        out: list[int] = []
        base = shown = at = 0  # tokens of the pieces that stay; tokens of the prefix so far; characters done
        pieces = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
        k = 0

        def show(counts: list[int]) -> None:
            nonlocal shown
            for count in counts:
                out.append(base + count - shown)
                shown = base + count

        while at < len(text):
            if run := _run.match(text, at):
                space = run[0]
                counts = self.counts(space.encode())[:]
                show(counts[1:])
                at = run.end()
                if at == len(text):
                    break
                base += counts[len(space[:-1].encode())]
                if space[-1] != " ":  # a space goes with what follows, other white space stands alone
                    base += self.counts(space[-1].encode())[-1]
                while pieces[k][1] < at or (pieces[k][1] == at and pieces[k][0] < at):
                    k += 1
            start, end = pieces[k]
            piece = text[start:end]
            counts = self.counts(piece.encode())[:]
            if piece in _CONTRACTIONS:  # not yet one at its second character
                counts[2] = counts[1] + self.counts(piece[1].encode())[-1]
            show(counts[1 + len(text[start:at].encode()) :])
            base, at, k = shown, end, k + 1
        if out and not -128 <= min(out) <= max(out) <= 127:
            raise ValueError("a byte changes the count by more than a signed byte holds")
        return bytes(x & 255 for x in out)

    def unit(self, unit: str) -> bytes:
        """The table of one unit."""
        if plain := _plain.fullmatch(unit):
            head = bytes(self.piece(plain[1].encode()))
            return head + self.marks(plain[2]) if plain[2] else head
        out, at = [], 0
        for special in self._special.finditer(unit):  # plain text up to its last character, where it becomes one token
            before = self.walk(unit[at : special.start()])
            grown = self.walk(unit[at : special.end()])[:-1]
            total = lambda table: sum(x - (x > 127) * 256 for x in table)
            out += (grown, bytes([total(before) + 1 - total(grown) & 255]))
            at = special.end()
        return b"".join([*out, self.walk(unit[at:])])

    def split(self, text: str) -> list[str]:
        """The units of a text."""
        if _odd.search(text):
            return _unit.findall(text)
        units = text.replace(" ", "\0 ").split("\0")  # every space starts a unit
        return units if units[0] else units[1:]

    def prefix_tables(self, texts: list[str | None]) -> list[bytes]:
        """For each text one signed byte for each of its UTF-8 bytes: the change of the token count."""
        split = [self.split(t) if t else [] for t in texts]
        found = [list(map(self.units.get, units)) for units in split]
        new = {u for units, parts in zip(split, found) if None in parts for u, p in zip(units, parts) if p is None}
        made = {unit: self.unit(unit) for unit in sorted(new)}
        out = [b"".join(parts if None not in parts else [made[u] if p is None else p for u, p in zip(units, parts)]) for units, parts in zip(split, found)]
        if self.held > KEPT_BYTES:
            self.units.clear()
            self.held = 0
        for unit, table in made.items():
            if len(unit) <= LONGEST_KEPT:
                self.units[unit] = table
                self.held += ENTRY_BYTES + len(unit) + len(table)
        self._text, self._last, self._count = b"", [-1], [0]
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_prefixes(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", tables: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_table (binary, one signed byte for each byte of the text).

    Counts are the library's without added special tokens; special strings inside a text count as it
    counts them. Null text is empty: no bytes, no tokens. Very long texts are batches of their own, in time
    and memory in proportion to their length. Repeated rows and null ids stay as they are; other columns are
    ignored; an empty table gives no rows. Without ``tables`` the tables are summed within the task and left out.
    """
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            for a, b, texts in wh.batches(batch, rows=BATCH_ROWS):
                made = prefixes.prefix_tables([t.decode() for t in texts])
                totals = [int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in made]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(map(len, made), pa.int64()), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())][: 3 + tables], ["doc_id", "n_bytes", "n_tokens", "prefix_table"][: 3 + tables])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix_table binary" * tables)


@F.pandas_udf(LongType())
def _tokens_of_prefix(tables: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(t[: max(0, n)], np.int8).sum(dtype=np.int64)) for t, n in zip(tables, n_bytes)])


@F.pandas_udf(LongType())
def _longest_prefix(tables: pd.Series, budget: pd.Series) -> pd.Series:
    def longest(t: bytes, most: int) -> int:
        fits = np.flatnonzero(np.cumsum(np.frombuffer(t, np.int8), dtype=np.int64) <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([longest(t, b) for t, b in zip(tables, budget)])


def tokens_of_prefix(prefix_table: Column, n_bytes: Column) -> Column:
    """Tokens of the first ``n_bytes`` bytes (whole characters) of a text, from its table."""
    return _tokens_of_prefix(prefix_table, n_bytes.cast("long"))


def longest_prefix(prefix_table: Column, budget: Column) -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens, from its table."""
    return _longest_prefix(prefix_table, budget.cast("long"))


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return token_prefixes(table(spark, sf_dir, "documents"), tables=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
