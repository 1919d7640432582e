"""Token ids in files of compressed byte planes.

Texts are range-partitioned by their ids and encoded in that order; each partition writes one file.
A file is a run of chunks of fixed size: the ids of a chunk are transposed into their four byte
planes, each compressed by itself, since the high bytes of token ids hardly vary.  Behind them stand
the chunk index (place, number of ids, length and checksum of each plane) and the documents in order.
A file is named by a fresh identifier and counts only once its row is in the manifest that Spark
commits, so that lost or repeated tasks leave nothing that is read.

The tokenizers library encodes each distinct piece once per worker; texts with a special token's
string go through it whole.  Nulls are empty texts (the end id alone); a null id sorts first; equal ids are ordered by
their texts; repeated rows are documents of their own.  Only the id and the text are read of other columns.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.llm.bpe import _ALL, Cache, Classes, encoded
from lumberline.llm.common import runs, staged

MAGIC = b"BYTEPLN1"
CHUNK = 1 << 16
END_ID = 2
_ENTRY = struct.Struct("<QI4I4I")  # place, ids, lengths of the planes, their checksums
_TAIL = struct.Struct("<QQQ8s")  # places of the chunk index and the document list, end of the list


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _engine_classes() -> bytes:
    """The class table as the library's own engine has it; made once on the driver, a few KB when compressed."""
    from tokenizers import Regex, normalizers

    def members(pattern: str) -> str:
        return normalizers.Replace(Regex(pattern.replace("\\p", "\\P").replace("\\s", "\\S") + "+"), "").normalize_str(_ALL)

    return zlib.compress(Classes(members).table.tobytes())


@lru_cache(maxsize=2)
def _codec(path: str, packed: bytes) -> tuple[Classes, Cache, list[bytes]]:
    tokenizer = _tokenizer(path)
    classes = Classes(lambda pattern: "")
    classes.table = np.frombuffer(zlib.decompress(packed), np.uint8)

    def encode(new: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([p.decode("utf-8") for p in new], add_special_tokens=False)]

    special = [t.content.encode("utf-8") for t in tokenizer.get_added_tokens_decoder().values()]
    return classes, Cache(encode, 1_000_000), special


def _documents(batches: Iterator[pa.RecordBatch], path: str, packed: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of documents: their doc_ids, the ids of all with end ids, and the number of each."""
    classes, cache, special = _codec(path, packed)
    for batch in batches:
        for piece in runs(batch, "text"):
            texts = piece.column("text")
            ids, starts = encoded(texts, classes, cache)
            parts = [ids[a:b] for a, b in zip(starts.tolist(), starts.tolist()[1:])]
            for i in _holding(texts, special):
                parts[i] = np.array(_tokenizer(path).encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            end = np.array([END_ID], np.uint32)
            counts = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
            yield piece.column("doc_id"), np.concatenate([x for p in parts for x in (p, end)]), counts


def _holding(texts: pa.Array, special: list[bytes]) -> list[int]:
    import pyarrow.compute as pc

    found: set[int] = set()
    for token in special:
        hits = pc.match_substring(texts, token.decode("utf-8"))
        found.update(np.flatnonzero(np.asarray(pc.fill_null(hits, False))).tolist())
    return sorted(found)


class PlaneWriter:
    """Writes chunks as ids come in; holds one chunk and the list of documents."""

    def __init__(self, stream):  # noqa: ANN001
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=1).compress
        self.place, self.index, self.rest = 0, [], np.zeros(0, np.uint32)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // CHUNK * CHUNK
        for at in range(0, whole, CHUNK):
            self._chunk(ids[at : at + CHUNK])
        self.rest = ids[whole:]

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.compress(p.tobytes()) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
        self.index.append(_ENTRY.pack(self.place, len(ids), *map(len, planes), *map(zlib.crc32, planes)))
        for plane in planes:
            self._put(plane)

    def close(self, documents: pa.Table) -> None:
        if len(self.rest):
            self._chunk(self.rest)
        index_at = self.place
        for entry in self.index:
            self._put(entry)
        list_at, sink = self.place, io.BytesIO()
        with pa.ipc.new_stream(sink, documents.schema) as out:
            out.write_table(documents)
        self._put(sink.getvalue())
        self._put(_TAIL.pack(index_at, list_at, self.place, MAGIC))


def _ids_of(file, index: bytes) -> Iterator[np.ndarray]:  # noqa: ANN001
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for place, count, *rest in _ENTRY.iter_unpack(index):
        file.seek(place)
        data = file.read(sum(rest[:4]))
        planes, at = np.empty((4, count), np.uint8), 0
        for i in range(4):
            plane = data[at : at + rest[i]]
            if zlib.crc32(plane) != rest[4 + i]:
                raise ValueError(f"a plane at byte {place + at} is damaged")
            planes[i] = np.frombuffer(expand.decompress(plane, max_output_size=count), np.uint8)
            at += rest[i]
        yield np.ascontiguousarray(planes.T).view("<u4").ravel()


def _opened(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    system, base = pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "", 1))
    return system, f"{base.rstrip('/')}/{name}"


def _read_file(folder: str, name: str, first: int, with_ids: bool) -> Iterator[list[pa.Array]]:
    system, place = _opened(folder, name)
    with system.open_input_file(place) as file:
        file.seek(file.size() - _TAIL.size)
        index_at, list_at, list_to, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not complete")
        file.seek(index_at)
        index = file.read(list_at - index_at)
        documents = pa.ipc.open_stream(io.BytesIO(file.read(list_to - list_at))).read_all().combine_chunks()
        yield from _documents_of(documents, _ids_of(file, index), first, with_ids)


def _documents_of(documents: pa.Table, chunks: Iterator[np.ndarray], at: int, with_ids: bool) -> Iterator[list[pa.Array]]:
    counts, doc_ids = documents["n"].to_pylist(), documents["doc_id"].combine_chunks()
    rest, done = np.zeros(0, np.uint32), 0
    while done < len(counts):
        # A few chunks' worth of documents at a time; a longer document stands alone.
        have, to = 0, done
        while to < len(counts) and (to == done or have + counts[to] <= 8 * CHUNK):
            have += counts[to]
            to += 1
        got, n = [rest], len(rest)
        while n < have:
            got.append(next(chunks))
            n += len(got[-1])
        ids = np.concatenate(got)
        ids, rest = ids[:have], ids[have:]
        ends = np.cumsum(counts[done:to])
        starts = ends - counts[done:to]
        raw = memoryview(ids.astype("<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [doc_ids.slice(done, to - done), pa.array(at + starts, pa.int64()), pa.array(counts[done:to], pa.int64()), pa.array(sums, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, have), pa.int32()), pa.array(ids, pa.int32())))
        yield columns
        at, done = at + have, to


def write_planes(df: DataFrame, folder: str, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the documents into files below ``folder``; returns their manifest ``(part, file, n_docs, n_tokens)``."""
    packed = _engine_classes()
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    by = [F.col("doc_id"), F.xxhash64("text")]
    ordered = source.repartitionByRange(*by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, listed, name, n = None, [], f"{uuid.uuid4().hex}.planes", 0
        for doc_ids, ids, counts in _documents(batches, path, packed):
            if writer is None:
                system, place = _opened(folder, name)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                writer = PlaneWriter(system.open_output_stream(place))
            writer.add(ids)
            listed.append(pa.table({"doc_id": doc_ids, "n": counts}))
            n += len(ids)
        if writer is not None:
            documents = pa.concat_tables(listed)
            writer.close(documents)
            writer.stream.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "n_docs": [documents.num_rows], "n_tokens": [n]}, schema=shape)

    shape = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    return staged(ordered.mapInArrow(write, "part int, file string, n_docs bigint, n_tokens bigint"), "planes-manifest")


def read_planes(spark: SparkSession, folder: str, manifest: DataFrame, id_type: T.DataType, *, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the files, one file per task, chunk by chunk.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over little-endian 32-bit ids.
    """
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = staged(manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "planes-read")
    fields = [T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    names = [f.name for f in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for columns in _read_file(folder, name, first, with_ids):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = max(1, listed.count())
    return listed.select("file", "first").repartition(parts).mapInArrow(read, T.StructType(fields))


def describe(folder: str, name: str) -> str:
    """The chunk index of a file as JSON, for people."""
    system, place = _opened(folder, name)
    with system.open_input_file(place) as file:
        file.seek(file.size() - _TAIL.size)
        index_at, list_at, _, _ = _TAIL.unpack(file.read(_TAIL.size))
        file.seek(index_at)
        return json.dumps([{"place": e[0], "ids": e[1], "planes": e[2:6]} for e in _ENTRY.iter_unpack(file.read(list_at - index_at))])
