"""Vectorized hashing of words, word runs and shingles over batches of whole texts.

Words of up to 32 bytes are taken 8 bytes at a time, each step passing through a bijective finalizer of 64 bits;
longer ones are hashed by XXH3. Neither is a polynomial in the word's bytes, so no family of texts collides by
construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
STEP, STEPS = 8, 4  # bytes a step, steps of a word before XXH3 takes over
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(STEP + 1)], np.uint64)
_places = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text that are hashed at once; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each raw[starts[i] : starts[i] + sizes[i]]; ``raw`` ends in STEP spare bytes."""
    eight = np.ndarray(len(raw) - STEP + 1, "<u8", raw, strides=(1,))
    out = mixed((eight[starts] & _KEPT[np.minimum(sizes, STEP)]) ^ (sizes.astype(np.uint64) * np.uint64(P)))
    for step in range(1, STEPS):
        more = np.flatnonzero(sizes > step * STEP)
        if not len(more):
            return out
        left = np.minimum(sizes[more] - step * STEP, STEP)
        out[more] = mixed((out[more] * np.uint64(Q)) ^ (eight[starts[more] + step * STEP] & _KEPT[left]))
    data = memoryview(raw)
    for i in np.flatnonzero(sizes > STEPS * STEP).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]], seed=11)
    return out


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the index of each text's first word with the end."""
    raw = np.frombuffer(b" ".join([*texts, bytes(STEP)]), np.uint8)
    if lower:
        raw = lower_ascii(raw)
    space = SPACES[raw]
    space[len(raw) - STEP :] = True
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return _word_hashes(raw, starts, ends - starts), np.searchsorted(starts, at)


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place, order included; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mixed(hashes[j : j + n] ^ _places[j])
    return mixed(out)


def batches(batch: pa.RecordBatch, text: str = "text", rows: int = 1 << 30) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a record batch of about BATCH_BYTES of text and at most ``rows`` rows: start, end and the texts in UTF-8, null as empty."""
    column = batch.column(text).cast(pa.binary())
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > start and (size + n > BATCH_BYTES or i - start >= rows):
            yield start, i, [t or b"" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column), [t or b"" for t in column.slice(start).to_pylist()]
