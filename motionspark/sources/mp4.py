"""Sample tables of MP4 and MOV files.

Spark lists the files; a task opens each of its own and reads only the boxes it needs by their ranges, so a file
is never held whole and may be of any size. Samples come in decode order; an edit list, or else the first shown
sample, is at time 0. Files without an index or a video track give one row with a reason and no samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sample entries of supported codecs and the boxes that configure them.
CODECS = {"avc1": "avcC", "avc3": "avcC", "hvc1": "hvcC", "hev1": "hvcC", "vp09": "vpcC", "av01": "av1C"}

SAMPLES = "path string, reason string, codec string, width int, height int, timescale long, nominal_fps double, sample_idx int, offset long, size int, dts long, cts long, key boolean"


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, body start, body end) of sibling boxes; a cut-off one ends the list, size 0 runs to the end."""
    at = start
    while at + 8 <= end:
        size, head = struct.unpack(">I", data[at : at + 4])[0], 8
        kind = bytes(data[at + 4 : at + 8]).decode("latin1")
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def find(data: memoryview, start: int, end: int, *path: str) -> tuple[int, int] | None:
    """Body of the first box down a path of types."""
    for kind in path:
        found = next(((a, b) for k, a, b in boxes(data, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
    return start, end


def _table(data: memoryview, at: tuple[int, int] | None, form: str, skip: int = 8) -> list[tuple]:
    """Entries of a full box that counts them in its second word."""
    if at is None:
        return []
    n, step = struct.unpack(">I", data[at[0] + skip - 4 : at[0] + skip])[0], struct.calcsize(form)
    body = data[at[0] + skip : at[0] + skip + n * step]
    return list(struct.iter_unpack(form, body[: len(body) // step * step]))


def codec_string(entry: str, config: bytes) -> str:
    """The codec parameter string of a visual sample entry."""
    if entry.startswith("avc") and len(config) >= 4:
        return f"{entry}.{config[1:4].hex()}"
    if entry in ("hvc1", "hev1") and len(config) >= 13:
        space = ["", "A", "B", "C"][config[1] >> 6]
        flags = int(f"{struct.unpack('>I', config[2:6])[0]:032b}"[::-1], 2)
        limits = config[6:12].rstrip(b"\0")
        tier = "H" if config[1] & 32 else "L"
        return ".".join([entry, f"{space}{config[1] & 31}", f"{flags:X}", f"{tier}{config[12]}", *[f"{b:X}" for b in limits]])
    if entry == "vp09" and len(config) >= 7:
        return f"vp09.{config[4]:02d}.{config[5]:02d}.{config[6] >> 4:02d}"
    if entry == "av01" and len(config) >= 3:
        return f"av01.{config[1] >> 5}.{config[1] & 31:02d}{'H' if config[2] >> 7 else 'M'}.{10 if config[2] & 64 else 8:02d}"
    return entry


def parse(path: str, content: bytes) -> list[tuple]:
    """Rows of SAMPLES of one file."""
    data, end = memoryview(content), len(content)
    refuse = lambda why: [(path, why, *[None] * 11)]
    moov = find(data, 0, end, "moov")
    if moov is None:
        return refuse("fragmented file" if any(k == "moof" for k, _, _ in boxes(data, 0, end)) else "no movie box")
    for kind, a, b in boxes(data, *moov):
        handler = find(data, a, b, "mdia", "hdlr") if kind == "trak" else None
        if handler and bytes(data[handler[0] + 8 : handler[0] + 12]) == b"vide":
            break
    else:
        return refuse("no video track")
    mdhd, stbl = find(data, a, b, "mdia", "mdhd"), find(data, a, b, "mdia", "minf", "stbl")
    if mdhd is None or stbl is None:
        return refuse("no sample table")
    stsd = find(data, *stbl, "stsd")
    entry, e0, e1 = next(boxes(data, stsd[0] + 8, stsd[1]))
    if entry not in CODECS:
        return refuse(f"unsupported codec {entry}")
    width, height = struct.unpack(">HH", data[e0 + 24 : e0 + 28])
    config = find(data, e0 + 78, e1, CODECS[entry])
    timescale = struct.unpack(">I", data[mdhd[0] + (20 if data[mdhd[0]] else 12) :][:4])[0]
    duration = struct.unpack(">Q", data[mdhd[0] + 24 :][:8])[0] if data[mdhd[0]] else struct.unpack(">I", data[mdhd[0] + 16 :][:4])[0]
    edits = find(data, a, b, "edts", "elst")
    shown = next((m for m in _media_times(data, edits) if m >= 0), None) if edits else None  # -1 is an empty edit
    get = lambda name: find(data, *stbl, name)
    deltas = [d for n, d in _table(data, get("stts"), ">II") for _ in range(n)]
    shifts = [d for n, d in _table(data, get("ctts"), ">Ii") for _ in range(n)]  # signed in every version
    stsz = get("stsz")
    fixed, count = struct.unpack(">II", data[stsz[0] + 4 : stsz[0] + 12])
    sizes = [fixed] * count if fixed else [s for (s,) in _table(data, stsz, ">I", 12)]
    chunks = [o for (o,) in (_table(data, get("stco"), ">I") if get("stco") else _table(data, get("co64"), ">Q"))]
    keys = {i - 1 for (i,) in _table(data, get("stss"), ">I")} if get("stss") else None
    runs = _table(data, get("stsc"), ">III")
    rows, at, dts = [], 0, 0
    for c, offset in enumerate(chunks, 1):
        per = next((n for first, n, _ in reversed(runs) if first <= c), 0)
        for _ in range(per):
            if at >= len(sizes):
                break
            rows.append([offset, sizes[at], dts, dts + (shifts[at] if at < len(shifts) else 0), keys is None or at in keys])
            dts += deltas[at] if at < len(deltas) else (deltas[-1] if deltas else 0)
            offset += sizes[at]
            at += 1
    start = shown if shown is not None else min((r[3] for r in rows), default=0)
    fps = len(rows) * timescale / duration if duration else 0.0
    codec = codec_string(entry, bytes(data[config[0] : config[1]]) if config else b"")
    return [(path, None, codec, width, height, timescale, fps, i, o, s, d - start, c - start, k) for i, (o, s, d, c, k) in enumerate(rows)]


def _media_times(data: memoryview, at: tuple[int, int]) -> list[int]:
    """The media times of an edit list."""
    form = ">Qqi" if data[at[0]] == 1 else ">Iii"
    return [m for _, m, _ in _table(data, at, form)]


def index_of(file, size: int) -> bytes:
    """The movie box of an open file with its header, found by the headers of the boxes before it; else the header of a fragment or nothing."""
    at, other = 0, b""
    while at + 8 <= size:
        head = file.read_at(16, at)
        length, kind = struct.unpack(">I", head[:4])[0], head[4:8]
        if length == 1 and len(head) == 16:
            length = struct.unpack(">Q", head[8:16])[0]
        length = length or size - at
        if length < 8 or at + length > size:
            break
        if kind == b"moov":
            return file.read_at(length, at)
        if kind == b"moof":
            other = struct.pack(">I4s", 8, b"moof")
        at += length
    return other


def _opened(path: str):
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SAMPLES of all files under ``path``; a file's index is read and parsed within one task."""
    names = [c.split()[0] for c in SAMPLES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f["path"]:
                with _opened(p) as file:
                    rows += parse(p, index_of(file, file.size()))
            yield pd.DataFrame(rows, columns=names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(run, SAMPLES)


def sample_bytes(samples: DataFrame) -> DataFrame:
    """path, sample_idx, data: the encoded bytes of each sample, read by their ranges in the order of the file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, rows in f.groupby("path", sort=False):
                with _opened(p) as file:
                    out += [(p, i, file.read_at(n, at)) for i, at, n in zip(rows["sample_idx"], rows["offset"], rows["size"])]
            yield pd.DataFrame(out, columns=["path", "sample_idx", "data"])

    wanted = samples.where("reason is null").select("path", "sample_idx", "offset", "size")
    return wanted.repartition("path", F.floor(F.col("offset") / 64_000_000)).sortWithinPartitions("path", "offset").mapInPandas(run, "path string, sample_idx int, data binary")


def frame_at(samples: DataFrame, index: int = 0) -> DataFrame:
    """The sample of each file that is shown at a place of the order of presentation, and the key sample that decoding starts from: path, sample_idx, cts, from_key."""
    shown = Window.partitionBy("path").orderBy("cts", "sample_idx")
    decoded = Window.partitionBy("path").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.where("reason is null").withColumns({"_at": F.row_number().over(shown) - 1, "from_key": F.max(F.when(F.col("key"), F.col("sample_idx"))).over(decoded)})
    return rows.where(F.col("_at") == index).select("path", "sample_idx", "cts", "from_key")


def clip_timing(clips: DataFrame, stated: str = "stated_fps", container: str = "container_fps") -> DataFrame:
    """Adds capture_fps, time_scale, stretched and looks_rendered; a stated rate of 0 counts as unset."""
    capture = F.coalesce(F.nullif(F.col(stated), F.lit(0)), F.col(container)).cast("double")
    scaled = clips.withColumn("capture_fps", capture).withColumn("time_scale", F.col(container) / F.nullif(F.col("capture_fps"), F.lit(0.0)))
    return scaled.withColumns({"stretched": F.abs(F.col("time_scale") - 1) > 0.02, "looks_rendered": (F.col(container) > 0) & (F.col(container) < 90)})
