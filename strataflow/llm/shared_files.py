"""Byte-level files in the shared folder, for formats that Spark's writers don't have.

Paths are URIs; ``file:`` is a mounted share, anything else goes through Arrow's file systems. Files
appear whole under their final name or not at all, so a repeated task attempt is harmless.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyarrow import fs


#: Schemes that Arrow knows by another name than Hadoop.
SAME = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(SAME.get(parsed.scheme, parsed.scheme) + uri[len(parsed.scheme) :])


class Writer:
    """Append bytes to a file that gets its name on ``close``; ``at`` is the length so far."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{attempt}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data: bytes) -> int:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def stream(uri: str):
    files, path = open_fs(uri)
    return files.open_input_stream(path, compression=None)


def read_range(uri: str, offset: int, length: int) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def attempt() -> str:
    """A name for this task attempt."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId()}-{c.taskAttemptId()}"
