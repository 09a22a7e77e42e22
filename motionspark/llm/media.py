"""Media columns: content-addressed payloads in tar shards.

A payload is stored once in a shard as a lossless image and addressed by its digest; a row carries the
digest, the shard, the offset and the length of the stored bytes. Metadata columns are filled by reading
only the header of a stored image, by its range; the whole image is read where pixels are wanted.

Each task writes one shard in the shared folder under a name of its own attempt, and a shard counts only
through the rows of the written index, so a task that is lost and run again leaves nothing that is read.
Two tasks may store the same payload; the index then settles on one place for all its rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, shared_dir, staged, table

WIDTH = 192
#: PNG's fixed values: signature, header length and the sizes of a chunk's frame.
SIGNATURE, HEADER_BYTES, FRAME = b"\x89PNG\r\n\x1a\n", 33, 12
TAR_BLOCK = 512
SPAN = 8_000_000  # bytes of neighbouring images that are read back at once


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with spaces appended up to a positive multiple of ``width``."""
    return data.ljust(max(1, -(-len(data) // width)) * width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as an 8-bit greyscale PNG, a row of ``width`` samples for each ``width`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each row is led by filter type 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict[str, int]:
    """Width, height, bits and colour type from the first HEADER_BYTES of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bits": bits, "colour": colour}


def from_png(data: bytes) -> bytes:
    """The samples of an 8-bit greyscale PNG whose rows have filter type 0."""
    width, at, body = png_header(data)["width"], 8, []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + FRAME
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file, with fixed owner and time so that equal shards are equal bytes."""
    head = bytearray(TAR_BLOCK)
    for at, text in ((0, name), (100, "0000644"), (108, "0000000"), (116, "0000000"), (124, f"{size:011o}"), (136, "00000000000"), (148, " " * 8), (156, "0"), (257, "ustar\0" + "00")):
        head[at : at + len(text)] = text.encode()
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


INDEX = "payload string, shard string, offset long, length long"


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Store each new payload of the task in one tar shard: the input's key columns, n_bytes and INDEX."""
    system, path = pafs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.tar"
    known: dict[bytes, tuple[int, int]] = {}  # digest: 32 bytes and two numbers for each distinct payload of the task
    out, at = None, 0
    try:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                payload = padded(text or b"", width)
                digest = hashlib.sha256(payload)
                place = known.get(digest.digest())
                if place is None:
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}")
                    image = to_png(payload, width)
                    out.write(tar_header(f"{digest.hexdigest()}.png", len(image)) + image + bytes(-len(image) % TAR_BLOCK))
                    place = known[digest.digest()] = at + TAR_BLOCK, len(image)
                    at += TAR_BLOCK + len(image) + -len(image) % TAR_BLOCK
                rows.append((len(text or b""), digest.hexdigest(), f"{path}/{name}", *place))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_bytes", "payload", "shard", "offset", "length"])
    finally:
        if out is not None:
            out.write(bytes(2 * TAR_BLOCK))
            out.close()


def store(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, payload (SHA-256), shard, offset, length: the written index of all rows."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "media")
    uri = folder if "://" in folder else f"file://{folder}"
    kind = dict(docs.dtypes)["doc_id"]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    index = staged(text.mapInArrow(partial(write_shard, folder=uri, width=width), f"doc_id {kind}, n_bytes long, {INDEX}"), "media-index")
    places = index.groupBy("payload").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return index.select("doc_id", "n_bytes", "payload").join(places, "payload").select("doc_id", "n_bytes", "payload", "place.*")


def _ranges(frame: pd.DataFrame, uri: str, lengths: list[int], gap: int) -> Iterator[bytes]:
    """The first ``lengths`` bytes of each stored image; ranges of a shard with up to ``gap`` bytes between them are read in one go."""
    system, _ = pafs.FileSystem.from_uri(uri)
    shards, offsets = frame["shard"].tolist(), frame["offset"].tolist()
    held, file, start, span = "", None, 0, b""
    for i, (shard, offset, length) in enumerate(zip(shards, offsets, lengths)):
        if shard != held:
            if file is not None:
                file.close()
            held, file, span = shard, system.open_input_file(shard), b""
        if not (start <= offset and offset + length <= start + len(span)):
            last = i
            while last + 1 < len(shards) and shards[last + 1] == shard and offset <= offsets[last + 1] and offsets[last + 1] + lengths[last + 1] - offset <= SPAN and offsets[last + 1] - offsets[last] - lengths[last] <= gap:
                last += 1
            start, span = offset, file.read_at(offsets[last] + lengths[last] - offset, offset)
        yield span[offset - start : offset - start + length]
    if file is not None:
        file.close()


METADATA = "payload string, width int, height int, bits int"


def read_headers(frames: Iterator[pd.DataFrame], uri: str) -> Iterator[pd.DataFrame]:
    """Rows of METADATA by reading only the header of each stored image."""
    for f in frames:
        heads = [png_header(h) for h in _ranges(f, uri, [HEADER_BYTES] * len(f), 0)]
        yield pd.DataFrame({"payload": f["payload"], **{k: [h[k] for h in heads] for k in ("width", "height", "bits")}})


FEATURES = "payload string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(samples: bytes, width: int) -> str:
    """Shape, mean and deviation of the samples and a 64-bit difference hash of an 8 x 8 grid of means."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, width)
    columns = pixels.reshape(len(pixels), 8, -1).mean(axis=2)
    edges = np.linspace(0, len(pixels), 9).astype(int)
    grid = np.array([columns[a : max(b, a + 1)].mean(axis=0) if a < len(pixels) else columns[-1] for a, b in zip(edges, edges[1:])])
    bits = (grid > np.roll(grid, 1, axis=1)).ravel()
    return f"{width}x{len(pixels)}:{pixels.mean():.3f}:{pixels.std():.3f}:{np.packbits(bits).tobytes().hex()}"


def read_images(frames: Iterator[pd.DataFrame], uri: str) -> Iterator[pd.DataFrame]:
    """Rows of FEATURES from the stored bytes."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for f in frames:
        out = []
        for payload, image in zip(f["payload"], _ranges(f, uri, f["length"].tolist(), 4 * TAR_BLOCK)):
            samples = from_png(image)
            out.append((payload, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples, png_header(image)["width"])))
        yield pd.DataFrame(out, columns=names)


def media_columns(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, the index, the header's metadata and the features read back, for each row.

    Null text is the empty payload, padded like any other; a very long text is one image, held whole by the
    task that stores it and the one that reads it; null and repeated doc_ids stay as they are;
    other columns are ignored; an empty table gives no rows.
    """
    index = staged(store(docs, width), "media-places")
    base = shared_dir(docs.sparkSession)
    uri = base if "://" in base else f"file://{base}"
    # One place for each payload, read in the order of the shards.
    # The number of tasks is given, as their cost is in the pixels and not in the rows that are dealt.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("payload", "shard", "offset", "length").distinct().repartition(tasks, "shard", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("shard", "offset")
    headers = places.mapInPandas(partial(read_headers, uri=uri), METADATA)
    images = places.mapInPandas(partial(read_images, uri=uri), FEATURES)
    return index.join(headers.join(images, "payload"), "payload")


def op9_media(spark, sf_dir: str) -> DataFrame:
    wanted = ["doc_id", "n_bytes", *[c.split()[0] for c in FEATURES.split(", ")[1:]]]
    return media_columns(table(spark, sf_dir, "documents")).select(*wanted, "width", "height", "bits")
