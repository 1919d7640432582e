"""Importance resampling towards a target: documents whose hashed features look like the target's, drawn without replacement.

Features are runs of words, hashed to a fixed number of buckets.  Each task counts its rows into one array of
buckets; the summed arrays of the corpus and of the target give the gain of each bucket, and one lookup
per feature in that array gives a document's weight.  Gumbel noise from the document's id makes the greatest
scores a draw in proportion to the weights.  The place of the cut is found by counting alone: exact count
jobs over the written scores bisect the score, then, among rows with the score at the cut, the id.  Only the
drawn rows are sorted, by a range partitioning, for their ranks.

Nulls: a null text has no words, a null id is written as empty and comes last among ties.  Ids that are not
whole numbers are compared as text, bytewise.  Rows with equal scores and ids are ordered by their number of
features; rows that are equal in that too give equal results, whichever is drawn.  Very long texts are
counted whole, long words byte by byte.  An empty target or corpus counts nothing; an empty table has no
rows.  Columns beside the id and the text are not read.  ``df`` is read twice, so it should be a table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.llm.common import Words, runs, staged
from lumberline.llm.numbered import numbered

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Thresholds that one count job tries side by side.
_TRIED = 15
#: Words of more bytes are summed one by one.
_LONG_WORD = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_TABLE = _crc_table()


def _crc_of(words: Words, which: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Checksums of the words ``which``, carried on from the checksums ``before``."""
    low, starts = words.low, words.starts[which]
    lengths = words.ends[which] - starts
    state = before ^ np.uint32(0xFFFFFFFF)
    # Longer words go last, so that those still open are a slice.
    order = np.argsort(lengths, kind="stable")
    at, ends, sums = starts[order], lengths[order], state[order]
    short = int(np.searchsorted(ends, _LONG_WORD, "right"))
    for i in range(int(ends[short - 1]) if short else 0):
        open_ = slice(int(np.searchsorted(ends[:short], i, "right")), short)
        sums[open_] = (sums[open_] >> np.uint32(8)) ^ _TABLE[(sums[open_] ^ low[at[open_] + i]) & np.uint32(255)]
    for i in range(short, len(ends)):
        sums[i] = zlib.crc32(low[at[i] : at[i] + ends[i]].tobytes(), int(sums[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state[order] = sums
    return state ^ np.uint32(0xFFFFFFFF)


def _features(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs: the row and the bucket of each run, in the order of the text."""
    row = words.rows()
    which = np.arange(len(words))
    sums = np.zeros(len(words), np.uint32)
    for n in range(longest):
        if n:
            inside = which + n < len(words)
            inside[inside] = row[which[inside]] == row[which[inside] + n]
            which, sums = which[inside], sums[inside]
            state = sums ^ np.uint32(0xFFFFFFFF)  # one space between words
            sums = ((state >> np.uint32(8)) ^ _TABLE[(state ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)
        sums = _crc_of(words, which + n, sums)
        yield row[which], (sums % np.uint32(buckets)).astype(np.int64)


def counted(texts: DataFrame, text: str = "text", *, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: ``buckets`` numbers, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in runs(batch, "text"):
                for _, found in _features(Words(piece.column("text")), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])

    source = texts.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = source.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, with one more count in each."""
    n, of, to = len(corpus), float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * of / ((float(corpus[i]) + 1) * to))) for i in range(n)], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of each row."""
    shared, buckets = df.sparkSession.sparkContext.broadcast(gain), len(gain)
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for piece in runs(batch, "text"):
                words, rows = Words(piece.column("text")), piece.num_rows
                number, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for row, bucket in _features(words, longest, buckets):
                    ends, sums = np.searchsorted(row, np.arange(rows + 1)), np.append(0, np.cumsum(gain[bucket]))
                    number += np.diff(ends)
                    weight += sums[ends[1:]] - sums[ends[:-1]]
                made = [pa.array(x, pa.int64()) for x in (np.diff(words.row_starts), number, weight)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *made], names=["doc_id", "n_words", "n_features", "weight"])

    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return source.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise)


def _numbers(rows: DataFrame, column: str) -> list[Column]:
    """Whole numbers whose order, one after another, is that of the column: nulls last, texts by their bytes."""
    empty = F.col(column).isNull().cast("bigint")
    if isinstance(rows.schema[column].dataType, T.IntegralType):
        return [empty, F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))]
    shown = F.coalesce(F.col(column).cast("string"), F.lit(""))
    longest = rows.agg(F.max(F.octet_length(shown))).first()[0] or 0
    # Seven bytes fit a number; a text that another one begins with is the smaller one.
    parts = [F.conv(F.rpad(F.substring(F.hex(shown.cast("binary")), 1 + 14 * i, 14), 14, "0"), 16, 10).cast("bigint") for i in range(-(-longest // 7))]
    return [empty, *parts, F.octet_length(shown).cast("bigint")]


def first_rows(rows: DataFrame, keys: Sequence[Column], most: int) -> Column:
    """Which rows are the first ``most`` in the order of numeric keys, the last of which is unique: a condition found by counts alone."""
    tied, left, chosen = F.lit(True), most, F.lit(False)
    for key in keys:
        here = rows.where(tied)
        low, high, n = here.agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= left:
            return chosen | tied
        if left <= 0:
            return chosen
        before = 0  # rows below low
        while low < high:
            step = max(1, (high - low) // (_TRIED + 1))
            tried = [low + step * i for i in range(_TRIED) if low + step * i < high]
            found = here.agg(*[F.count(F.when(key <= F.lit(t), 1)) for t in tried]).first()
            at = next((i for i, c in enumerate(found) if c >= left), len(tried))
            if at:
                low, before = tried[at - 1] + 1, found[at - 1]
            if at < len(tried):
                high = tried[at]
        chosen, left = chosen | (tied & (key < F.lit(low))), left - before
        tied = tied & (key == F.lit(low))
    return chosen | tied


def resample(
    df: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``: every document's score, and the ranks of the drawn ones.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.
    """
    gain = gains(counted(df, text, longest=longest, buckets=buckets), counted(target, target_text, longest=longest, buckets=buckets))
    scored = weighted(df, gain, id_col=id_col, text=text, longest=longest, seed=seed)
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    able = scored.where(F.col("n_words") >= least_words)
    keys = [-F.col("score"), *_numbers(able, "doc_id"), F.col("n_features"), F.col("row")]
    most = able.count() * percent // 100
    drawn = (F.col("n_words") >= least_words) & first_rows(able, keys, most)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(scored.where(drawn), keys, "resampling-drawn").withColumn("rank", F.col("place") + 1)
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return reduce(DataFrame.unionByName, [x.select(*columns, "rank") for x in (ranked, rest)])
