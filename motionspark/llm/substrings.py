"""Substring dedup: remove what a window of words shares with an earlier document.

The reference for a document is every document with a smaller id, so the reference is the corpus
itself. It is cut into shards by content: each window of ``window`` words is led by its least run of
``anchor`` words, and all windows of equal words have the same leader, so leaders that only one document
holds are dropped first, by an aggregation of hashes. What remains is grouped by leader. Each group is a
reference shard: a suffix automaton is built from its distinct stretches, each state marked with the
first document that holds it, and the stretches of all documents that share the leader are streamed
through it for matching statistics. Where a match is at least a window long, the state tells the first
document with that window, and the maximal spans of windows known from earlier documents are removed.

An automaton goes only to the task whose documents need it; broadcasting all of them would send the
repeated part of the corpus to every executor, which has no bound. A shard of more than ``most`` different
stretches is parted by content: its windows are dealt by how far the leader lies from their start, in ranges
of ``WIDTHS`` places, and by the words that all windows of such a range share. Equal windows always stay
together, and at a width of one place a shard is a single window, so every shard fits a task whatever a
leader's number of stretches, and every one goes through an automaton. Stretches are told apart by a
cryptographic digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import drop_staged, staged, table

WINDOW = 50
ANCHOR = 8
MOST = 1_000  # different stretches of a shard
WIDTHS = (6, 1)
LAST = 2**63 - 1  # stands for a null id

SEGMENTS = "doc long, row long, key long, content binary, at int, n int, lead int"


def leaders(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one leader: (first window, last window, leader's place and hash).

    ``first``: index of each text's first word, with the end.
    """
    none = np.zeros(0, np.int64)
    grams = wh.runs_of(hashes, anchor)
    wide = window - anchor + 1
    if len(grams) < wide:
        return none, none, none, np.zeros(0, np.uint64)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(place))
    text_end = np.repeat(first[1:], np.diff(first))[: len(place)]
    valid = starts + window <= text_end
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return begin, stop, place[begin], grams[place[begin]]


def digest(words: bytes) -> bytes:
    """The address of a sequence of words, joined by one space."""
    return hashlib.blake2b(words, digest_size=16).digest()


def segments(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENTS: the stretches of each document, with the digest of their words."""
    for batch in batches:
        docs, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
        for a, b, texts in wh.batches(batch):
            hashes, first = wh.words(texts)
            begin, stop, lead, key = leaders(hashes, first, window, anchor)
            if not len(begin):
                continue
            own = [w for t in texts for w in t.split()]  # by the same white space as WORD
            ends = np.cumsum([len(w) + 1 for w in own])
            joined = b" ".join(own)
            starts, stops = (ends[begin] - [len(own[i]) + 1 for i in begin]).tolist(), (ends[stop + window - 1] - 1).tolist()
            content = [digest(joined[x:y]) for x, y in zip(starts, stops)]
            text = np.searchsorted(first, begin, "right") - 1
            columns = [docs[a:b][text], rows[a:b][text], key.view(np.int64), content, (begin - first[text]).astype(np.int32), (stop - begin + 1).astype(np.int32), (lead - begin).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if c is content else pa.array(c) for c in columns], ["doc", "row", "key", "content", "at", "n", "lead"])


#: A stretch: its words joined by one space, the leader's place among them, and the first document that holds it.
PIECES = "key long, content binary, doc long, words string, lead int"
_piece_names = [c.split()[0] for c in PIECES.split(", ")]
_piece_kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32()]


def pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES: the wanted stretches of each text; of neighbouring rows that are alike, the first gives them."""
    before = None
    for batch in batches:
        out: list[tuple] = []
        for doc, row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "wanted"))):
            if (doc, row) == before:
                continue
            before, own = (doc, row), text.encode().split()
            out += [(w["key"], w["content"], doc, b" ".join(own[w["at"] : w["at"] + w["n"] + window - 1]).decode(), w["lead"]) for w in wanted]
        columns = list(zip(*out)) or [[]] * len(_piece_names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _piece_kinds)], _piece_names)


CUT = f"whole_key long, whole_content binary, off int, {PIECES}"


def parted(batches: Iterator[pa.RecordBatch], window: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of CUT: a stretch's windows whose leader lies in one range of ``width`` places, as a stretch of its own.

    Its key is made of the words that all windows of the range share, so equal windows keep an equal key.
    """
    for batch in batches:
        out: list[tuple] = []
        for key, content, doc, words, lead in zip(*(batch.column(c).to_pylist() for c in _piece_names)):
            own = words.split(" ")
            last = len(own) - window  # the last window
            for part in range(max(0, lead - last) // width, lead // width + 1):
                from_, to = max(0, lead - (part + 1) * width + 1), min(last, lead - part * width)
                shared = own[lead - part * width : lead - (part + 1) * width + 1 + window]
                name = digest(f"{key} {part} {' '.join(shared)}".encode())
                held = " ".join(own[from_ : to + window])
                out.append((key, content, from_, int.from_bytes(name[:8], "little", signed=True), digest(held.encode()), doc, held, lead - from_))
        columns = list(zip(*out)) or [[]] * (3 + len(_piece_names))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.binary(), pa.int32(), *_piece_kinds])], ["whole_key", "whole_content", "off", *_piece_names])


class SuffixAutomaton:
    """A suffix automaton over word sequences, each state marked with the first owner of its words.

    Sequences are added by ascending owner, so a state's owner is that of the sequence that made it.
    """

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def add(self, words: list[str], owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            held = nxt[last].get(word)
            if held is not None and length[held] == length[last] + 1:
                last = held
                continue
            if held is not None:
                new = self._clone(held, last, word)
                last = new
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            owners.append(owner)
            at = last
            while at >= 0 and word not in nxt[at]:
                nxt[at][word] = new
                at = link[at]
            if at >= 0:
                held = nxt[at][word]
                link[new] = held if length[held] == length[at] + 1 else self._clone(held, at, word)
            last = new

    def _clone(self, held: int, at: int, word: str) -> int:
        """A copy of state ``held`` for its words that end a step from ``at``."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[held]))
        link.append(link[held])
        self.length.append(self.length[at] + 1)
        self.owner.append(self.owner[held])
        while at >= 0 and nxt[at].get(word) == held:
            nxt[at][word] = new
            at = link[at]
        link[held] = new
        return new

    def first_owners(self, words: list[str], window: int) -> list[int]:
        """Matching statistics: for each window of ``words`` its first owner, -1 if none has it."""
        nxt, link, length, owner = self.next, self.link, self.length, self.owner
        state = matched = 0
        out = []
        for i, word in enumerate(words, 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                out.append(owner[state])
            elif i >= window:
                out.append(-1)
        return out


OWNERS = "key long, content binary, off array<int>, n array<int>, owner array<long>"


def owners(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Rows of OWNERS from pieces sorted by key: runs of a stretch's windows and their first document."""

    def shard(group: list[tuple]) -> list[tuple]:
        automaton, out = SuffixAutomaton(), []
        split = [words.split(" ") for _, _, _, words in group]
        for (_, _, doc, _), words in zip(group, split):
            automaton.add(words, doc)
        for (key, content, _, _), words in zip(group, split):
            found = automaton.first_owners(words, window)
            starts = [i for i, x in enumerate(found) if i == 0 or x != found[i - 1]]
            out.append((key, content, starts, [b - a for a, b in zip(starts, [*starts[1:], len(found)])], [found[i] for i in starts]))
        return out

    names = [c.split()[0] for c in OWNERS.split(", ")]
    held: list[tuple] = []
    for frame in frames:
        out: list[tuple] = []
        for row in zip(frame["key"], frame["content"], frame["doc"], frame["words"]):
            if held and held[0][0] != row[0]:
                out += shard(held)
                held = []
            held.append(row)
        if out:
            yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame(shard(held), columns=names)


CLEANED = "n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"


def clean(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id and CLEANED: texts without the words that their spans of windows cover."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            own = (text or "").encode().split()
            merged: list[list[int]] = []
            for start, end in sorted((s["at"], s["at"] + s["n"] - 1 + window) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            left = own
            for start, end in reversed(merged):
                left = left[:start] + left[end:]
            n_words.append(len(own))
            n_removed.append(len(own) - len(left))
            kept.append(b" ".join(left).decode())
            removed.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kind)],
            ["doc_id", "n_words", "n_removed", "kept", "removed"],
        )


def judged(stretches: DataFrame, most: int) -> DataFrame:
    """Adds ``hot``: whether a key has more than ``most`` stretches."""
    crowded = stretches.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("_hot"))
    return stretches.join(crowded, "key", "left").withColumn("hot", F.coalesce("_hot", F.lit(False))).drop("_hot")


def known_windows(stretches: DataFrame, window: int, most: int) -> DataFrame:
    """Rows of OWNERS for stretches (rows of PIECES, one for each key and content): who holds their windows first."""
    shards, parts = [], []
    for width in WIDTHS:
        level = staged(judged(stretches, most), "repeat-level")
        shards.append(level.where("not hot").drop("hot"))
        hot = level.where("hot").drop("hot")
        if hot.isEmpty():
            break
        part = staged(hot.mapInArrow(partial(parted, window=window, width=width), CUT), "repeat-parts")
        parts.append(part.select("whole_key", "whole_content", "off", "key", "content"))
        held = part.groupBy("key", "content").agg(F.min("doc").alias("doc"), F.first(F.struct("words", "lead")).alias("r"))
        stretches = held.select("key", "content", "doc", "r.words", "r.lead")
    else:
        shards.append(stretches)  # single windows
    by_shard = shards[0]
    for more in shards[1:]:
        by_shard = by_shard.unionByName(more)
    by_shard = by_shard.select("key", "content", "doc", "words").repartition("key").sortWithinPartitions("key", "doc", "content")
    known = staged(by_shard.mapInPandas(partial(owners, window=window), OWNERS), "repeat-known")
    for part in reversed(parts):
        moved = F.transform("k.off", lambda o: o + F.col("p.off")).alias("off")
        up = part.alias("p").join(known.alias("k"), ["key", "content"]).select(F.col("whole_key").alias("key"), F.col("whole_content").alias("content"), moved, "k.n", "k.owner")
        known = known.unionByName(up)
    return known


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), removed (spans of words).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with
    a smaller doc_id; windows are judged on the input. Defined cases: null text has no words; shorter
    texts lose nothing; a null doc_id counts as larger than any other and is no smaller than another
    null; rows with equal doc_id are one document's rows and do not remove from each other; other
    columns are ignored; an empty table gives no rows; a very long text is cut whole into stretches and is one row like
    any other. No stretch, leader or partner is capped.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = staged(texts.select("doc", "row", "text").mapInArrow(partial(segments, window=window, anchor=anchor), SEGMENTS), "repeat-segments")
    # Written, so that the join below is a stage of its own and a hot leader's rows can be dealt to many tasks.
    shared = staged(found.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"), "repeat-shared")
    wanted = staged(found.join(shared, "key"), "repeat-wanted")
    drop_staged(found)
    drop_staged(shared)

    # The words of a stretch are taken from one of its holders, the first document.
    distinct = wanted.groupBy("key", "content").agg(F.min(F.struct("doc", "row", "at", "n", "lead")).alias("r")).select("key", "content", "r.*")
    asked = distinct.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n", "key", "content", "lead")).alias("wanted"))
    cut = staged(texts.select("doc", "row", "text").join(asked, ["doc", "row"]).mapInArrow(partial(pieces, window=window), PIECES), "repeat-pieces")

    known = known_windows(cut, window, most).select("key", "content", F.arrays_zip("off", "n", "owner").alias("runs"))
    own = F.transform(F.filter("runs", lambda r: r["owner"] < F.col("doc")), lambda r: F.struct((F.col("at") + r["off"]).alias("at"), r["n"].alias("n"))).alias("own")
    lost = wanted.join(known, ["key", "content"]).select("doc", "row", own).where(F.size("own") > 0)
    spans = staged(lost.groupBy("doc", "row").agg(F.flatten(F.collect_set("own")).alias("spans")), "repeat-spans")
    for used in (wanted, cut):
        drop_staged(used)
    kind = dict(docs.dtypes)["doc_id"]
    return texts.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans").mapInArrow(partial(clean, window=window), f"doc_id {kind}, {CLEANED}")


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
dup AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM dup),
g AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
