"""Files as planned byte ranges: a Python Data Source that hashes them where they are read.

``byte_ranges`` lists files and cuts them into ranges; a partition is one range, or a run of
small files, of about ``partition_bytes``. A task reads its range in pieces of ``PIECE``
bytes and keeps only the running hash, so neither a file's size nor a task's memory is
bounded by the other. It gives one row a block:

    path string, size long (of the file), modified timestamp, offset long, length long, sha256 string

With ``block_bytes`` = 0 a file is one block, hashed in order by one task: the plain SHA-256
of the file. Otherwise blocks of that length are hashed by as many tasks as there are ranges,
and ``evidence.tree_digest`` combines them.

Files are reached through ``pyarrow.fs`` (local and mounted folders, and the stores it
knows by their URI scheme). A path may end in a pattern (``*``, ``?``, ``[...]``) for the
file name. Empty files have one block of length 0; folders and what matches nothing give no row.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import posixpath
from datetime import timezone
from typing import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, modified timestamp, offset long, length long, sha256 string"
PIECE = 8 << 20
#: Schemes of ``pyarrow.fs``; other stores are left to Spark's own sources.
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def reaches(path: str) -> bool:
    """Whether this source can open ``path``."""
    return "://" not in path and not path.startswith("file:") or path.split(":", 1)[0] in SCHEMES


def locate(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path on it, and what to put before a path to name it again."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file://"
    if "://" not in path:
        return pafs.LocalFileSystem(), path, "file://"
    system, own = pafs.FileSystem.from_uri(path)
    return system, own, path[:len(path) - len(own)] if path.endswith(own) else path.split("://", 1)[0] + "://"


def list_files(path: str) -> list[tuple[str, int, object]]:
    """(path, size, modification time) of the files that a path or pattern names."""
    system, own, before = locate(path)
    folder, name = posixpath.split(own)
    if any(c in name for c in "*?["):
        found = system.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(posixpath.basename(f.path), name)]
    else:
        found = [system.get_file_info(own)]
        if found[0].type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(own, recursive=True))
    return [(before + f.path, f.size, f.mtime) for f in found if f.type == pafs.FileType.File]


class Ranges(InputPartition):
    """Byte ranges (path, size, modification time, start, stop) that one task reads."""

    def __init__(self, ranges: list[tuple]):
        super().__init__(0)
        self.ranges = ranges


def plan(files: list[tuple], block: int, partition: int) -> list[Ranges]:
    """Ranges end at block borders; small files share a partition."""
    out, here, held = [], [], 0
    for path, size, modified in sorted(files):
        step = max(block, partition // block * block) if block else max(size, 1)
        for start in range(0, max(size, 1), step):
            stop = min(size, start + step)
            if here and held + stop - start > partition:
                out.append(Ranges(here))
                here, held = [], 0
            here.append((path, size, modified, start, stop))
            held += stop - start
    return [*out, Ranges(here)] if here else out


def hashed(stream, start: int, stop: int) -> str:
    """SHA-256 of a range, read in pieces."""
    h, at = hashlib.sha256(), start
    stream.seek(start)
    while at < stop:
        piece = stream.read(min(PIECE, stop - at))
        if not piece:
            raise OSError(f"the file ended at {at}, before {stop}")
        h.update(piece)
        at += len(piece)
    return h.hexdigest()


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.block, self.partition = int(options.get("block_bytes", 0)), int(options.get("partition_bytes", 128 << 20))

    def partitions(self) -> list[Ranges]:
        files = {f[0]: f for p in self.paths for f in list_files(p)}
        return plan(list(files.values()), self.block, self.partition) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, size, modified, start, stop in partition.ranges:
            system, own, _ = locate(path)
            block = self.block or max(1, stop - start)
            with system.open_input_file(own) as stream:
                for lo in range(start, max(stop, start + 1), block):
                    hi = min(stop, lo + block)
                    yield path, size, modified.astimezone(timezone.utc), lo, hi - lo, hashed(stream, lo, hi)


class ByteRangeSource(DataSource):
    """``spark.read.format("byte_ranges").option("paths", json list)`` with ``block_bytes``
    and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteRangeReader:
        return ByteRangeReader(self.options)
