"""``spark.read.format("frames")``: uncompressed video (Y4M) and pictures (PNG) as rasters.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").load(folder)

Frames of a Y4M file have one size, so a task knows where its own begin and a file is split anywhere; each frame's marker is
checked. A folder of PNG files is a clip whose frames are the files in the order of their names. Filters on path and frame are pushed down.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from .files import SPLIT, Asked, Ranges, listed

FRAMES = "path string, clip_id long, frame int, t double, w int, h int, rgba binary"
#: How a chroma plane is smaller than the picture (across, down), by the format's names.
CHROMA = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "411": (4, 1), "444": (1, 1), "mono": None}
MARK = b"FRAME"
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def header(first: bytes) -> dict:
    """What the first line of a Y4M file says: w, h, fps, chroma, full (range), and where its first frame begins."""
    line = first.split(b"\n", 1)[0]
    if not line.startswith(b"YUV4MPEG2") or len(line) == len(first):
        raise ValueError("no Y4M header")
    words = {w[:1]: w[1:] for w in line.decode("ascii", "replace").split()[1:] if not w.startswith("X")}
    kind = words.get("C", "420")
    if kind not in CHROMA:
        raise ValueError(f"chroma {kind} is not 8 bits of a known layout")
    up, down = (int(x) for x in words.get("F", "0:1").split(":"))
    return {"w": int(words["W"]), "h": int(words["H"]), "fps": up / down if down and up else 25.0, "chroma": CHROMA[kind], "full": b"COLORRANGE=FULL" in line or kind == "420jpeg", "start": len(line) + 1}


def planes(head: dict) -> list[tuple[int, int]]:
    """(height, width) of a frame's planes."""
    w, h = head["w"], head["h"]
    if head["chroma"] is None:
        return [(h, w)]
    across, down = head["chroma"]
    small = (-(-h // down), -(-w // across))
    return [(h, w), small, small]


def to_rgba(data: bytes, head: dict) -> np.ndarray:
    """An h x w x 4 raster of a frame's planes; chroma is the nearest sample's, colours are those of standard definition."""
    at, parts = 0, []
    for h, w in planes(head):
        parts.append(np.frombuffer(data, np.uint8, h * w, at).reshape(h, w).astype(float))
        at += h * w
    y, (u, v) = parts[0], (parts[1:] if len(parts) == 3 else (np.full((1, 1), 128.0),) * 2)
    if len(parts) == 3:
        across, down = head["chroma"]
        u, v = (np.repeat(np.repeat(c, down, axis=0), across, axis=1)[: head["h"], : head["w"]] for c in (u, v))
    if not head["full"]:
        y, u, v = (y - 16) * (255 / 219), 128 + (u - 128) * (255 / 224), 128 + (v - 128) * (255 / 224)
    u, v = u - 128, v - 128
    rgb = np.stack(np.broadcast_arrays(y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u), axis=-1)
    return np.dstack([np.clip(np.round(rgb), 0, 255).astype(np.uint8), np.full((head["h"], head["w"]), 255, np.uint8)])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its filtered form: none, left, above, their mean, or the one of three neighbours nearest to their plane."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for i, x in enumerate(line.tolist(), step):
        a, b, c = int(out[i - step]), int(up[i]), int(up[i - step])
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (x + guess) & 255
    return out[step:].astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """An h x w x 4 raster of a PNG of 8 bits without interlace: grey or colours, with or without alpha, or a palette."""
    if not data.startswith(PNG_HEAD):
        raise ValueError("no PNG")
    at, packed, palette, clear = 8, [], b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if bits != 8 or laced:
        raise ValueError("only 8 bits without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    rows, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for i in range(h):
        rows[i] = above = _unfiltered(int(raw[i, 0]), raw[i, 1:], above, channels)
    image = rows.reshape(h, w, channels)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([table, alpha[:, None]], axis=1)[image[..., 0]]
    colours = np.repeat(image[..., :1], 3, axis=2) if channels < 3 else image[..., :3]
    alpha = image[..., -1:] if channels in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([colours, alpha], axis=2)


def clip_of(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - 2**63


class Part(InputPartition):
    """Bytes of a Y4M file, or some pictures: (URI, place in their folder)."""

    def __init__(self, path: str, start: int = 0, end: int = 0, pictures: tuple[tuple[str, int], ...] = ()):
        self.path, self.start, self.end, self.pictures = path, start, end, pictures


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.split, self.fps = options["path"], int(options.get("split", SPLIT)), float(options.get("fps", 30))
        self.asked = Asked("frame")
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.asked.take(filters)

    def partitions(self) -> list[Part]:
        parts = [Part(uri, at, min(at + self.split, size)) for uri, size, _ in listed(self.root, r"\.y4m$") if self.asked.path(uri) for at in range(0, max(size, 1), self.split)]
        for folder, files in groupby(listed(self.root, r"\.png$"), lambda f: f[0].rsplit("/", 1)[0]):
            held, bytes_held = [], 0
            for place, (uri, size, _) in enumerate(files):
                if self.asked.path(uri) and self.asked.row(place):
                    held.append((uri, place))
                    bytes_held += size
                if bytes_held >= self.split:
                    parts.append(Part(folder, pictures=tuple(held)))
                    held, bytes_held = [], 0
            if held:
                parts.append(Part(folder, pictures=tuple(held)))
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        for uri, place in part.pictures:
            with Ranges(uri) as file:
                image = read_png(file.read_at(file.size(), 0))
                self.bytes_read += file.bytes_read
            yield uri, clip_of(part.path), place, place / self.fps, image.shape[1], image.shape[0], image.tobytes()
        if not part.pictures:
            with Ranges(part.path) as file:
                yield from self._frames(file, part)
                self.bytes_read += file.bytes_read

    def _frames(self, file: Ranges, part: Part) -> Iterator[tuple]:
        head = header(file.read_at(512, 0))
        size = sum(h * w for h, w in planes(head))
        step = len(MARK) + 1 + size
        number = max(0, -(-(part.start - head["start"]) // step))
        at = head["start"] + number * step
        while at < part.end and number <= self.asked.high:
            if self.asked.row(number):
                data = file.read_at(step, at)
                if data[: len(MARK) + 1] != MARK + b"\n":
                    raise ValueError(f"{part.path}: no plain frame at byte {at}; frames with parameters of their own are not read")
                if len(data) == step:  # a cut-off last frame is left out
                    rgba = to_rgba(data[len(MARK) + 1 :], head)
                    yield part.path, clip_of(part.path), number, number / head["fps"], head["w"], head["h"], rgba.tobytes()
            number, at = number + 1, at + step


class FrameSource(DataSource):
    """Rows of FRAMES. Options: ``split``, bytes of a task; ``fps``, of PNG sequences, which don't tell (30)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)
