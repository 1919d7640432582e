"""Files that tasks read parts of, wherever Spark's own readers find them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

#: The connector's settings of an object store, by the name that the file system here has for each.
_S3 = {
    "access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token",
    "endpoint_override": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region",
}


@dataclass(frozen=True)
class Storage:
    """Opens files by their paths.  It travels with a task and takes the session's store settings along."""

    settings: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(spark: SparkSession) -> Storage:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        names = [*_S3.values(), "fs.s3a.connection.ssl.enabled"]
        return Storage(tuple((name, value) for name in names if (value := conf.get(name))))

    def resolve(self, path: str) -> tuple[fs.FileSystem, str]:
        """The file system of a path and the path in it.  ``s3a`` and ``s3n`` are names of ``s3``."""
        parts = urlsplit(path)
        if parts.scheme in ("", "file"):
            plain = path if not parts.scheme else path[len("file:") :]
            plain = "/" + plain.lstrip("/") if parts.scheme else plain
            return fs.LocalFileSystem(), plain if os.path.lexists(plain) else unquote(plain)
        if parts.scheme in ("s3", "s3a", "s3n"):
            given = dict(self.settings)
            options = {name: given[key] for name, key in _S3.items() if given.get(key)}
            if given.get("fs.s3a.connection.ssl.enabled", "true").lower() == "false":
                options["scheme"] = "http"
            return fs.S3FileSystem(**options), path.split("://", 1)[1]
        return fs.FileSystem.from_uri(path)

    def open(self, path: str):  # noqa: ANN201
        """A file for reading some of its bytes only."""
        system, inside = self.resolve(path)
        return system.open_input_file(inside)

    def head(self, folder: str) -> str:
        """What stands before a path inside the file system to name the file."""
        parts = urlsplit(folder)
        if parts.scheme in ("", "file"):
            return "file://"
        return f"{parts.scheme}://" if parts.scheme in ("s3", "s3a", "s3n") else f"{parts.scheme}://{parts.netloc}"

    def files(self, folder: str) -> list[tuple[str, int, float]]:
        """All files below a folder: path, size, time of the last change."""
        system, inside = self.resolve(folder)
        found = system.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
        head = self.head(folder)
        return [(head + i.path, i.size, i.mtime.timestamp() if i.mtime else 0.0) for i in found if i.type == fs.FileType.File]


def range_lines(handle, first: int, start: int, stop: int, limit: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes, bool]]:
    """The lines that start in ``[start, stop)``: the byte each starts at, its bytes without the line end, whether it has one.

    Nothing is read before ``first``, where a line starts, or from ``limit`` on.  A line that runs into the range
    belongs to the range before.
    """
    at, rest = start, b""
    skipping = start > first
    place = start - 1 if skipping else start
    while place < limit:
        data = handle.read_at(min(step, limit - place), place)
        if not data:
            break
        place += len(data)
        pieces = (rest + data).split(b"\n")
        rest = pieces.pop()
        if skipping and pieces:
            at = place - len(rest) - sum(len(p) + 1 for p in pieces[1:])
            del pieces[0]
            skipping = False
        for piece in pieces:
            if at >= stop:
                return
            yield at, piece.removesuffix(b"\r"), True
            at += len(piece) + 1
        if skipping:
            rest = b""  # still in a line of an earlier range
        elif at >= stop:
            return
    if rest and not skipping:
        yield at, rest, False
