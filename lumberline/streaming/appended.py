"""A stream of the bytes that are appended to log files.

The offset of the stream has, for each file, its generation, how many of its bytes were delivered, and a
mark of the bytes just before.  A file that is shorter than what was delivered, or whose bytes at the mark have
changed, was replaced: its generation grows and it is delivered from its beginning.  Any number of
tasks read what is new in ranges of bounded size; a line belongs to the range it starts in, and a last piece
without its line end says so.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumberline.sources.storage import Storage, range_lines

FORMAT = "appended_log"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
MARK_BYTES = 4096          # bytes before the delivered end that must not have changed
RANGE_BYTES = 64 << 20     # bytes that one task reads
SCHEMA = "file_path string, generation bigint, seq bigint, line binary, terminated boolean"
_ARROW = pa.schema([("file_path", pa.string()), ("generation", pa.int64()), ("seq", pa.int64()), ("line", pa.binary()), ("terminated", pa.bool_())])


class _Range(InputPartition):
    """Bytes of a file: lines that start from ``start`` to ``stop``; none is read beyond ``limit``."""

    def __init__(self, path: str, generation: int, first: int, start: int, stop: int, limit: int) -> None:
        self.path, self.generation, self.first, self.start, self.stop, self.limit = path, generation, first, start, stop, limit


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.pattern = options["folder"], options.get("pattern", "*")
        self.checkpoint, self.range_bytes = options.get("checkpoint"), int(options.get("rangeBytes", RANGE_BYTES))
        self.storage = Storage(tuple(map(tuple, json.loads(options.get("settings", "[]")))))
        self.known: dict | None = None
        self.seen: dict[str, tuple[int, float]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _logged(self) -> dict:
        """The last offset that the query has written down, for a query that was started again."""
        if not self.checkpoint:
            return {}
        names = [p for p, _, _ in self.storage.files(f"{self.checkpoint}/offsets") if p.rsplit("/", 1)[1].isdigit()]
        if not names:
            return {}
        with self.storage.open(max(names, key=lambda p: int(p.rsplit("/", 1)[1]))) as handle:
            _, _, *offsets = handle.readall().decode("utf-8").split("\n")
        given = [json.loads(o) for o in offsets if o.startswith("{")]
        root = self.storage.head(self.folder) + self.storage.resolve(self.folder)[1]
        mine = [o for o in given if all(isinstance(e, dict) and "mark" in e and p.startswith(root) for p, e in o.items())]
        return mine[0] if mine else {}

    def _mark(self, path: str, end: int) -> str:
        start = max(0, end - MARK_BYTES)
        with self.storage.open(path) as handle:
            return hashlib.blake2b(handle.read_at(end - start, start), digest_size=8).hexdigest()

    def _head(self, path: str, size: int) -> bytes:
        with self.storage.open(path) as handle:
            return handle.read_at(size, 0)

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self._logged()
        out = dict(self.known)
        for path, size, changed in self.storage.files(self.folder):
            name = path.rsplit("/", 1)[1]
            if not fnmatch(name, self.pattern) or self.seen.get(path) == (size, changed):
                continue
            if size < len(BYTE_ORDER_MARK) and BYTE_ORDER_MARK.startswith(self._head(path, size)):
                continue  # the rest of the mark is still to come
            before, generation = self.known.get(path), 0
            if before is not None:
                same = size >= before["bytes"] and self._mark(path, before["bytes"]) == before["mark"]
                generation = before["generation"] + (0 if same else 1)
            out[path] = {"generation": generation, "bytes": size, "mark": self._mark(path, size)}
            self.seen[path] = (size, changed)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, now in end.items():
            before = start.get(path)
            first = before["bytes"] if before and before["generation"] == now["generation"] else 0
            for at in range(first, now["bytes"], self.range_bytes):
                out.append(_Range(path, now["generation"], first, at, min(at + self.range_bytes, now["bytes"]), now["bytes"]))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bool]] = []
        size = 0
        with self.storage.open(partition.path) as handle:
            for at, line, ended in range_lines(handle, partition.first, partition.start, partition.stop, partition.limit):
                rows.append((at, line.removeprefix(BYTE_ORDER_MARK) if at == 0 else line, ended))
                size += len(line)
                if len(rows) == 8192 or size > 8 << 20:
                    yield self._batch(partition, rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(partition, rows)

    @staticmethod
    def _batch(part: _Range, rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
        at, lines, ended = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(at)), pa.array([part.generation] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(lines, pa.binary()), pa.array(ended)],
            schema=_ARROW,
        )


class AppendedLog(DataSource):
    """``folder`` and below it files like ``pattern``; ``checkpoint`` is that of the query, which tells what was read before."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return AppendedReader(dict(self.options))


def read_appended(spark: SparkSession, folder: str, pattern: str = "*.log", checkpoint: str | None = None, **options: str) -> DataFrame:
    """The lines appended to the files below a folder, as ``streaming.tail`` follows them.

    ``file_path, generation, seq, text, terminated``; ``seq`` is the byte a line or piece starts at.  Text is UTF-8;
    a piece may end within a character, whose other bytes come with the next piece.
    """
    spark.dataSource.register(AppendedLog)
    given = {"folder": folder, "pattern": pattern, "settings": json.dumps(Storage.of(spark).settings), **options}
    if checkpoint:
        given["checkpoint"] = checkpoint
    raw = spark.readStream.format(FORMAT).options(**given).load()
    return raw.select("file_path", "generation", "seq", F.col("line").cast("string").alias("text"), "terminated")


def follow(spark: SparkSession, folder: str, table: str, pattern: str = "*.log", **trigger: object):  # noqa: ANN201
    """Follow the files below a folder into the table at ``table``."""
    from lumberline.streaming.tail import stream_records

    return stream_records(read_appended(spark, folder, pattern, f"{table}/checkpoint"), table, **trigger)
