"""What the operators share: running numpy code over text columns, hashes of words, and lookups of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.session import staged

__all__ = ["annotate", "is_training_row", "lookup", "mixed", "runs", "spread", "staged", "table", "text_bytes", "Words"]

#: Numpy works on about so much text at a time: enough for long loops, small beside a worker's memory.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training_row(doc_id: Column) -> Column:
    """Whether models may learn from the row: the checksum of its id modulo 4 is not 2.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without a copy, and the offsets of its rows in them.  Null is empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def runs(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least.  No row is cut."""
    _, ends = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def annotate(
    df: DataFrame, fields: Sequence[tuple[str, str]], prepare: Callable[[], Callable[[pa.Array], list]],
    *, text: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """``carry`` columns of each row, and columns computed from its text in Arrow batches.

    ``prepare`` runs once per task and returns a function from a slice of texts to one array per
    field.  A carried column whose name clashes with a new field gives way to it.
    """
    new = {name.lower() for name, _ in fields}
    kept = [c for c in dict.fromkeys(carry) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            for piece in runs(batch, "__text"):
                made = compute(piece.column("__text"))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + made, names=[*kept, *(n for n, _ in fields)])

    return source.mapInArrow(work, schema)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123 or 65 <= c < 91)]] = 0

_STEP, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _powers(length: int) -> np.ndarray:
    powers = np.full(length, _STEP | np.uint64(1), np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


class Words:
    """The words of a slice of texts: runs of ASCII letters and digits and of all bytes beyond ASCII, A-Z lower-cased."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = text_bytes(texts)
        self.low = _LOWER[data]
        inside = self.low != 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        #: row i has the words row_starts[i] to row_starts[i + 1]
        self.row_starts = np.searchsorted(self.starts, self.offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.row_starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        longest = 1 << max(6, int(lengths.max() - 1).bit_length())
        return mixed(np.add.reduceat(self.low[self._inside] * _powers(longest)[place], at) + lengths.astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` consecutive words of one row, and the number of the first word of each."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total = (total + hashes[i : i + count]) * _MIX_1
        at = np.arange(count)
        row = self.rows()
        same = row[:count] == row[n - 1 :]
        return mixed(total[same]), at[same]


def spread(name: str, parts: int) -> Column:
    """A part from 0 to ``parts - 1`` by the hash of a column."""
    return F.pmod(F.xxhash64(F.col(name)), F.lit(parts))


def lookup(left: DataFrame, unique: DataFrame, key: str, weight: str, hot: int = 10_000) -> DataFrame:
    """Left join with a table of unique keys, of which a few may hold a great part of all left rows.

    ``weight`` is a column of ``unique``: how many left rows have the key.  Keys of over
    1 / ``hot`` of all left rows are ``hot`` at most, so that they fit a broadcast; the others
    are joined by a shuffle in which no key has more than that share.
    """
    total = unique.agg(F.sum(weight)).first()[0] or 0
    bound = max(1000, total // hot)
    many = unique.where(F.col(weight) > bound).drop(weight)
    others = [c for c in many.columns if c != key]
    first = left.join(F.broadcast(many.withColumn("__hot", F.lit(True))), key, "left")
    found = first.where("__hot").select(*left.columns, *others)
    rest = first.where("__hot is null").select(*left.columns)
    return found.unionByName(rest.join(unique.where(F.col(weight) <= bound).drop(weight), key, "left").select(*left.columns, *others))
