"""Listing and ranged reading of files for data sources, and what their pushed filters ask for."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

#: Bytes of a file that one task reads.
SPLIT = 128_000_000


def listed(path: str, pattern: str) -> list[tuple[str, int, int]]:
    """(URI, bytes, time of change in ns) of the files under a folder, or of one file, whose names match; in order of their URIs."""
    system, name = pafs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.\-]*:", path) else f"file://{path}")
    scheme = re.match(r"([a-z][a-z0-9+.\-]*://[^/]*)?", path)[0] or "file://"
    at = system.get_file_info(name)
    found = system.get_file_info(pafs.FileSelector(name, recursive=True)) if at.type == pafs.FileType.Directory else [at]
    return sorted((f"{scheme}{f.path if f.path.startswith('/') else '/' + f.path}", f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File and re.search(pattern, f.base_name, re.IGNORECASE))


class Ranges:
    """An open file that is read by ranges and counts the bytes."""

    def __init__(self, uri: str):
        system, name = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(name)
        self.bytes_read = 0

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        data = self.file.read_at(n, at)
        self.bytes_read += len(data)
        return data


class Asked:
    """What pushed filters leave of files and of the numbers of things in them; filters that are not understood go back to Spark."""

    def __init__(self, number: str, flags: tuple[str, ...] = ()):
        self.number, self.flags = number, flags
        self.paths: set[str] | None = None
        self.low, self.high = 0, 2**62
        self.wanted: dict[str, bool] = {}

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if column == "path" and isinstance(f, (EqualTo, In)):
            named = set(f.value) if isinstance(f, In) else {f.value}
            self.paths = named if self.paths is None else self.paths & named
        elif column in self.flags and isinstance(f, EqualTo) and isinstance(f.value, bool):
            if self.wanted.get(column, f.value) != f.value:
                self.high = -1
            self.wanted[column] = f.value
        elif column == self.number and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def path(self, uri: str) -> bool:
        return self.paths is None or uri in self.paths

    def row(self, number: int, **flags: bool) -> bool:
        return self.low <= number <= self.high and all(flags[c] == v for c, v in self.wanted.items() if c in flags)
