"""A data source of GeoJSON FeatureCollections that reads one file in many tasks."""

from __future__ import annotations

import json
import re

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a task is given, unless the option `bytes` says otherwise.
PART_BYTES = 8_000_000
_FEATURES = re.compile(rb'"features"\s*:\s*\[')
_DECODER = json.JSONDecoder()


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; ValueError where only Spark's readers reach it."""
    try:
        return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    except (OSError, NotImplementedError) as e:
        raise ValueError(f"no file system for {path}") from e


class _Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.base, self.size, self.data = file, at, size, b""
        file.seek(at)

    def grow(self) -> bool:
        more = self.file.read(max(65_536, len(self.data)))
        self.data += more
        return bool(more)

    def find(self, what: bytes, at: int, end: int) -> int:
        """The place of the next occurrence before `end` (-1: none)."""
        while True:
            i = self.data.find(what, at - self.base, end - self.base)
            if i >= 0:
                return self.base + i
            if self.base + len(self.data) >= end or not self.grow():
                return -1

    def parse(self, at: int):
        """The JSON value at a place and where it ends; (None, at + 1) if there is none."""
        while True:
            text = self.data[at - self.base :].decode("utf-8", "ignore")
            try:
                value, n = _DECODER.raw_decode(text)
                return value, at + len(text[:n].encode())
            except json.JSONDecodeError as e:
                # an error well before the end of what was read isn't for want of more
                if e.pos < len(text) - 8 and not e.msg.startswith("Unterminated") or not self.grow():
                    return None, at + 1


def features(file, start: int, end: int, size: int):
    """Features whose first byte is in [start, end). In the midst of a file the first one is the first
    object that is a Feature; from there on they follow each other."""
    w = _Window(file, start, size)
    at = start
    if start == 0:
        while not (m := _FEATURES.search(w.data)):
            if not w.grow():
                return
        at = m.end()
    while at < end and (at := w.find(b"{", at, end)) >= 0:
        value, after = w.parse(at)
        if isinstance(value, dict) and value.get("type") == "Feature":
            yield value
            at = after
            w.data, w.base = w.data[at - w.base :], at
        else:
            at += 1


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, bytes_: int):
        self.path, self.bytes = path, bytes_

    def partitions(self) -> list[_Part]:
        store, path = resolve(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        sizes = {f.path: f.size for f in found}
        return [_Part(f, a, min(a + self.bytes, sizes[f]), sizes[f]) for f in files for a in range(0, sizes[f], self.bytes)]

    def read(self, part: _Part):
        store, _ = resolve(self.path)
        with store.open_input_file(part.path) as file:
            for f in features(file, part.start, part.end, part.size):
                g = f.get("geometry") or {}
                said = {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in (f.get("properties") or {}).items()}
                yield said, g.get("type"), json.dumps(g.get("coordinates"))


class GeoJsonSource(DataSource):
    """spark.read.format("riverlens_geojson").load(path): a row for each feature. Option `bytes`: the
    size of a task's part of a file."""

    @classmethod
    def name(cls) -> str:
        return "riverlens_geojson"

    def schema(self) -> str:
        return "properties map<string, string>, type string, coordinates string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("bytes", PART_BYTES)))
