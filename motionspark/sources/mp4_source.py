"""``spark.read.format("mp4")`` and ``readStream``: MP4 and MOV files as tables of samples, with their encoded bytes if asked for.

    spark.dataSource.register(Mp4Source)
    spark.read.format("mp4").option("data", "true").load(folder).where("key AND path = '...'")

A task has a stretch of a file's bytes: it reads the file's index and gives the samples that begin in its stretch, so a
large file is many tasks' work and nothing but file names passes through the driver. With ``spark.sql.python.filterPushdown.enabled``
filters on path leave files out before anything is opened, and those on key and sample_idx before bytes are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition
from pyspark.sql.types import StructType

from . import mp4
from .files import SPLIT, Asked, Ranges, listed

NAMES = r"\.(mp4|m4v|mov)$"


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def stretches(files: list[tuple[str, int, int]], split: int) -> list[Stretch]:
    return [Stretch(uri, at, min(at + split, size)) for uri, size, _ in files for at in range(0, max(size, 1), split)]


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.data = options.get("data", "false").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.asked = Asked("sample_idx", ("key",))
        self.bytes_read = 0

    def read(self, part: Stretch) -> Iterator[tuple]:
        with Ranges(part.path) as file:
            rows = mp4.parse(part.path, mp4.index_of(file, file.size()))
            for row in rows:
                if row[1] is not None:  # a file without samples: the first stretch tells why
                    if part.start == 0 and not self.asked.wanted and self.asked.low == 0 and self.asked.high == 2**62:
                        yield (*row, None) if self.data else row
                    continue
                number, offset, size, key = row[7], row[8], row[9], row[12]
                if part.start <= offset < part.end and self.asked.row(number, key=key):
                    yield (*row, file.read_at(size, offset)) if self.data else row
            self.bytes_read += file.bytes_read


class Mp4Reader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.asked.take(filters)

    def partitions(self) -> list[Stretch]:
        return stretches([f for f in listed(self.root, NAMES) if self.asked.path(f[0])], self.split)


class Mp4StreamReader(_Reading, DataSourceStreamReader):
    """New files by their time of change. An offset holds the latest time and the names that share it, not every file there was."""

    def initialOffset(self) -> dict:
        return {"time": -1, "names": "[]"}

    def latestOffset(self) -> dict:
        files = listed(self.root, NAMES)
        last = max((t for _, _, t in files), default=-1)
        return {"time": last, "names": json.dumps([uri for uri, _, t in files if t == last])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        def upto(uri: str, time: int, offset: dict) -> bool:
            return time < offset["time"] or (time == offset["time"] and uri in json.loads(offset["names"]))

        return stretches([f for f in listed(self.root, NAMES) if upto(f[0], f[2], end) and not upto(f[0], f[2], start)], self.split)


class Mp4Source(DataSource):
    """Rows of ``mp4.SAMPLES``, with a column ``data`` if the option of that name is true. Option ``split``: bytes of a task's stretch."""

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return mp4.SAMPLES + (", data binary" if self.options.get("data", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Mp4Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Mp4StreamReader(self.options)
