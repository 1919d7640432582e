"""Benchmark decontamination by a prefix-filtered containment join.

Items are cut into windows of ten consecutive words; a shorter item is one window.  A document
contains a window only if it contains each of its shingles (three consecutive words, fewer in
shorter windows), so one necessary shingle per window is joined: its rarest one, by counts over the
whole corpus.  A match fixes where the window would stand; it must fit between the ends of the
document (the length and positional bounds), and is then compared word by word.

Items travel to the tasks in blocks whose size is checked; more items make more blocks, each of which
goes through the documents and adds to what was found.

Nulls: items without id or text are left out, a null document has no words.  Empty items, and items
without words, have no windows.  Repeated documents are rows of their own; repeated item ids join
their windows.  Columns of the documents whose names clash with the new ones give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import Words, annotate, runs

WINDOW, SHINGLE = 10, 3
#: Item texts that one broadcast may hold.
BLOCK_BYTES = 16 << 20

FIELDS = [("n_words", "bigint"), ("spans", "array<struct<start:bigint,end:bigint>>"), ("items", "array<string>")]


@dataclass
class Windows:
    """Distinct windows of a block of items: word hashes side by side, the exact words, and the items of each."""

    lengths: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    words: list[bytes]
    items: list[list[str]]

    def shingles(self) -> Iterator[tuple[int, int, np.uint64]]:
        """(window, offset, shingle) for every shingle of every window, by the hash that documents use."""
        for i, (start, length) in enumerate(zip(self.starts.tolist(), self.lengths.tolist(), strict=True)):
            n = min(SHINGLE, length)
            lone = Words(pa.array([self.words[i].decode("utf-8")]))
            grams, at = lone.grams(self.hashes[start : start + length], n)
            yield from zip([i] * len(at), at.tolist(), grams, strict=True)


def windows_of(items: list[tuple[str, str]], size: int = WINDOW) -> Windows:
    texts = Words(pa.array([t for _, t in items], pa.string()))
    hashes, low = texts.hashes(), texts.low.tobytes()
    spelled = [low[a:b] for a, b in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)]
    found: dict[bytes, set[str]] = {}
    first: dict[bytes, tuple[int, int]] = {}
    for (item, _), start, end in zip(items, texts.row_starts.tolist(), texts.row_starts.tolist()[1:], strict=False):
        length = min(size, end - start)
        for at in range(start, end - length + 1) if length else ():
            key = b" ".join(spelled[at : at + length])
            found.setdefault(key, set()).add(item)
            first.setdefault(key, (at, length))
    lengths = np.array([first[k][1] for k in found], np.int64)
    parts = [hashes[first[k][0] : sum(first[k])] for k in found]
    return Windows(lengths, np.cumsum(lengths) - lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint64), list(found), [sorted(s) for s in found.values()])


class Keys:
    """A sorted set of hashes; most strangers are turned away by one look at a small table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = np.sort(keys), max(16, int(len(keys) * 16).bit_length())
        self.near = np.zeros(1 << self.bits, bool)
        self.near[self.keys & np.uint64((1 << self.bits) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and the number of the key of each."""
        maybe = np.flatnonzero(self.near[hashes & np.uint64((1 << self.bits) - 1)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], at[same]


def _shingle_counts(docs: DataFrame, text: str, by_length: dict[int, Keys]) -> dict[int, int]:
    """How often each shingle of the windows occurs in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(k.keys), np.int64) for n, k in by_length.items()}
        for batch in batches:
            for piece in runs(batch, "text"):
                words = Words(piece.column("text"))
                hashes = words.hashes()
                for n, keys in by_length.items():
                    _, which = keys.find(words.grams(hashes, n)[0])
                    totals[n] += np.bincount(which, minlength=len(keys.keys))
        for n, keys in by_length.items():
            seen = np.flatnonzero(totals[n])
            yield pa.RecordBatch.from_arrays([pa.array(keys.keys[seen].view(np.int64)), pa.array(totals[n][seen])], names=["shingle", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "shingle bigint, n bigint")
    # No more rows than the block of items has shingles.
    return {r.shingle & (2**64 - 1): r.n for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


@dataclass
class Prefixes:
    """For each shingle length, its prefix keys and, side by side, the windows each stands for and its offset in them."""

    windows: Windows
    joined: dict[int, tuple[Keys, np.ndarray, np.ndarray, np.ndarray]]

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: the window, and the number of its first word."""
        hashes, w = words.hashes(), self.windows
        found_windows, found_at = [], []
        for n, (keys, first, which, offsets) in self.joined.items():
            grams, places = words.grams(hashes, n)
            hit, key = keys.find(grams)
            many = first[key + 1] - first[key]
            entry = np.repeat(first[key] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            window, at = which[entry], np.repeat(places[hit], many) - offsets[entry]
            ends = at + w.lengths[window]
            row = np.searchsorted(words.row_starts, np.repeat(places[hit], many), "right") - 1
            fits = (at >= words.row_starts[row]) & (ends <= words.row_starts[row + 1])
            window, at = window[fits], at[fits]
            for step in range(WINDOW):  # by hash, for as long as windows have words
                live = w.lengths[window] > step
                same = ~live
                same[live] = hashes[at[live] + step] == w.hashes[w.starts[window[live]] + step]
                window, at = window[same], at[same]
            found_windows.append(window)
            found_at.append(at)
        window, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_windows, found_at))
        low = words.low.tobytes() if len(at) else b""
        spelled = [
            b" ".join(low[a:b] for a, b in zip(words.starts[i : i + n].tolist(), words.ends[i : i + n].tolist(), strict=True))
            for i, n in zip(at.tolist(), w.lengths[window].tolist(), strict=True)
        ]
        exact = np.fromiter((w.words[k] == s for k, s in zip(window.tolist(), spelled, strict=True)), bool, len(at))
        return window[exact], at[exact]


def _prefixes(windows: Windows, docs: DataFrame, text: str) -> Prefixes:
    listed = list(windows.shingles())
    sized: dict[int, list[tuple[int, int, int]]] = {}
    for window, offset, gram in listed:
        sized.setdefault(min(SHINGLE, int(windows.lengths[window])), []).append((window, offset, int(gram)))
    counts = _shingle_counts(docs, text, {n: Keys(np.array(sorted({g for _, _, g in rows}), np.uint64)) for n, rows in sized.items()}) if listed else {}
    joined = {}
    for n, rows in sized.items():
        rarest: dict[int, tuple[int, int, int]] = {}
        for window, offset, gram in rows:
            rank = (counts.get(gram, 0), gram, offset)
            rarest[window] = min(rarest.get(window, rank), rank)
        chosen = sorted((gram, window, offset) for window, (_, gram, offset) in rarest.items())
        keys = Keys(np.array(sorted({g for g, _, _ in chosen}), np.uint64))
        grams = np.array([g for g, _, _ in chosen], np.uint64)
        first = np.append(np.searchsorted(grams, keys.keys), len(grams))
        joined[n] = (keys, first, np.array([w for _, w, _ in chosen], np.int64), np.array([o for _, _, o in chosen], np.int64))
    return Prefixes(windows, joined)


def _found(texts: pa.Array, prefixes: Prefixes) -> list[pa.Array]:
    words = Words(texts)
    window, at = prefixes.matches(words)
    n_rows = len(words.row_starts) - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + prefixes.windows.lengths[window], -1)
    inside = np.cumsum(edge[:-1]) > 0
    row = words.rows()
    change = np.diff(inside.astype(np.int8), prepend=0)
    change_row = np.diff(row, prepend=-1) > 0
    starts = np.flatnonzero(inside & ((change == 1) | change_row))
    last = np.append(~inside[1:] | change_row[1:], True) if len(inside) else inside
    ends = np.flatnonzero(inside & last) + 1
    span_row = row[starts]
    base = words.row_starts[span_row]
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], names=["start", "end"])
    items: dict[int, set[str]] = {}
    for k, r in zip(window.tolist(), row[at].tolist() if len(at) else [], strict=True):
        items.setdefault(r, set()).update(prefixes.windows.items[k])
    return [
        pa.array(np.diff(words.row_starts), pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(span_row, np.arange(n_rows + 1)), pa.int32()), spans),
        pa.array([sorted(items.get(i, ())) for i in range(n_rows)], pa.list_(pa.string())),
    ]


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", carry: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``spans`` (of words inside any occurrence), ``items`` (ids as strings, sorted), ``n_hit``.

    ``carry`` columns come along; with several blocks of items, spans of different blocks may overlap.
    """
    spark = docs.sparkSession
    given = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col("`text`").cast("string").alias("text")).where("item is not null and text is not null")
    bytes_ = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-bytes_ // block_bytes))
    new = {"n_words", "spans", "items", "n_hit"}
    kept = [c for c in dict.fromkeys(carry) if c.lower() not in new]
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__body"))
    n_words, spans, items = None, [], []
    for block in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        prefixes = spark.sparkContext.broadcast(_prefixes(windows_of([(r.item, r.text) for r in rows]), docs, text))

        def prepare(shared=prefixes) -> Callable[[pa.Array], list]:  # noqa: ANN001
            return lambda texts: _found(texts, shared.value)

        fields = [(f"__{name}_{block}", kind) for name, kind in FIELDS]
        more = ["__body"] if block < blocks - 1 else []
        found = annotate(found, fields, prepare, text="__body", carry=[*kept, *more, *spans, *items, *([n_words] if n_words else [])])
        n_words = n_words or f"__n_words_{block}"
        spans.append(f"__spans_{block}")
        items.append(f"__items_{block}")
    all_spans = F.col(spans[0]) if blocks == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*spans))))
    all_items = F.col(items[0]) if blocks == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*items))))
    union = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    named = found.select(*[F.col(f"`{c}`") for c in kept], F.col(n_words).alias("n_words"), all_spans.alias("spans"), all_items.alias("items"))
    return named.withColumn("n_hit", union)
