"""Packing token ids into sequences of one length: first-fit decreasing, in randomised groups of documents.

Documents are encoded where they are read.  Whole lengths of a long document are sequences by themselves; what is left of each
goes to a random group whose size does not depend on the table's.  A group sorts its pieces, longest
first, and puts each into the first sequence that has room, which a tournament tree of the room left
finds in logarithmic time.  Wide gaps that remain are filled from the emptiest sequences, whose pieces
are cut for it; the one sequence that stays unfilled is cut at powers of two, lengths that need no padding.

A null text is empty and has the end id alone.  Rows are documents of their own, also if ids repeat or are
null.  Pieces of equal length are ordered by checksum, id and ids, so that a group packs alike however its rows
arrive.  Very long texts are encoded whole by one task, and only their ends go to a group.  An empty table has no pieces.
Columns beside the id and the text are not read.  ``df`` should be a table, since the random groups
of rows follow the order in which it is read, also when a lost task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.llm.bpe import Cache
from lumberline.llm.common import runs, text_bytes

LENGTH, END_ID = 4096, 2
#: Bytes of text in a group, on average: some 100 sequences.
GROUP_BYTES = 2 << 20
#: Gaps of fewer ids are padded, since filling them takes a cut each.
LEAST_GAP = 16
#: Pieces of more bytes are encoded one by one and not kept.
_LONG_PIECE = 64

# Kinds of bytes.  A run between blanks that has a byte of the kind ODD, which may be part of a contraction, of a
# special token, of a letter beyond ASCII or of other white space, stays whole; any other run is cut between kinds.
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    for i in range(33, 127):
        c = chr(i)
        kinds[i] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _ODD if c in "'<" else _SIGN
    kinds[[9, 10, 13, 32]] = _BLANK
    return kinds


_KIND = _kinds()
_PLAIN = bytes(i for i in range(256) if _KIND[i] in (_LETTER, _DIGIT, _SIGN))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and keeps words, digits and runs of signs apart.

    Each distinct piece is encoded once: a lower-cased word, a digit or a run of signs, or a whole run between blanks
    where the library's own rules may see more in it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Cache(self._encode, 1_000_000)
        # What stands between pieces that are encoded as one text: a sign that none of them has.
        (self.between,) = self.tokenizer.encode("!", add_special_tokens=False).ids

    def _whole(self, runs_: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([r.decode("utf-8") for r in runs_], add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        # Words, digits and signs of ASCII are what the library's rules would hand to its model, byte for letter.
        tokens = self.tokenizer.model.tokenize
        rest = [p.translate(None, _PLAIN) for p in pieces]
        out = [[] if r else [t.id for t in tokens(p.decode("ascii"))] for p, r in zip(pieces, rest, strict=True)]
        odd = [i for i, r in enumerate(rest) if r]
        for i, found in zip(odd, self._whole([pieces[i] for i in odd]), strict=True):
            out[i] = found
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each text (and the end)."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kinds = _KIND[data]
        inside = kinds != _BLANK
        fresh = np.zeros(len(data), bool)
        fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | fresh[1:]
        closes[:-1] &= ~inside[1:] | fresh[1:]
        run_starts, run_ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        odd_before = np.append(0, np.cumsum(kinds == _ODD))
        odd = odd_before[run_ends] > odd_before[run_starts]
        whole = np.zeros(len(data) + 1, np.int8)
        whole[run_starts[odd]] += 1
        whole[run_ends[odd]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
        # A piece begins with a run and, in runs that are cut, at each digit and each change of kind.
        cut = np.zeros(len(data), bool)
        cut[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        starts = np.flatnonzero(opens | (cut & inside & ~whole))
        ends = np.minimum(np.append(starts[1:], len(data)), run_ends[np.cumsum(opens)[starts] - 1])
        shown = np.where(whole, data, _LOW[data])
        lengths = ends - starts
        long = np.flatnonzero(lengths > _LONG_PIECE)
        kept = lengths.copy()
        for i in long:
            inside[starts[i] : ends[i]], kept[i] = False, 0
        edges = np.append(0, np.cumsum(kept))
        slices = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(shown[inside])])
        ids, counts = self.cache(slices)
        counts = counts.astype(np.int64)
        if len(long):  # which the cache has seen as empty
            found = [np.array(self._whole([shown[starts[i] : ends[i]].tobytes()])[0], np.uint32) for i in long]
            at = np.append(0, np.cumsum(counts))[long]
            ids = np.insert(ids, np.repeat(at, [len(f) for f in found]), np.concatenate(found))
            counts[long] = [len(f) for f in found]
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = ("start", "length", "ids_crc32", "doc_tokens")


def _cut(df: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """Pieces of at most a sequence: whole ones without their ids, what is left of each document with them."""
    source = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in _PIECES), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for part in runs(batch, "text"):
                ids, starts = encode(part.column("text"))
                from_row, found, left = [], [], []
                for i, (a, b) in enumerate(zip(starts.tolist(), starts.tolist()[1:])):
                    own = np.append(ids[a:b], np.uint32(END_ID))
                    for at in range(0, len(own), LENGTH):
                        piece = own[at : at + LENGTH].astype("<u4").tobytes()
                        n = len(piece) // 4
                        from_row.append(i)
                        found.append((at, n, zlib.crc32(piece), len(own)))
                        left.append(piece if n < LENGTH else None)
                columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4
                taken = part.take(pa.array(from_row, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column("row"), taken.column("doc_id"), *columns, pa.array(left, pa.binary())], names=schema.names)

    return source.mapInArrow(work, schema)


class Room:
    """A tournament tree over the room that sequences have left: each inner node has the most of its two halves."""

    def __init__(self, sequences: int, length: int):
        self.size = 1 << max(0, sequences - 1).bit_length()
        self.most = [length] * (2 * self.size)

    def put(self, length: int) -> int:
        """The first sequence with room for so many ids, whose room shrinks by them."""
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < length:
                at += 1
        place = at - self.size
        most[at] -= length
        while at > 1:
            at //= 2
            left, right = most[2 * at], most[2 * at + 1]
            most[at] = left if left > right else right
        return place


def first_fit(lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """Which pieces each sequence has, by first-fit; the pieces come longest first."""
    # Two sequences are never both half empty, so there are no more than this.
    room = Room(min(len(lengths), 2 * sum(lengths) // length + 1), length)
    packed: list[list[int]] = []
    for i, n in enumerate(lengths):
        place = room.put(n)
        if place == len(packed):
            packed.append([])
        packed[place].append(i)
    return packed


Part = tuple[int, int, int]  # a piece, its first id, how many


def filled(packed: list[list[Part]], least_gap: int = LEAST_GAP, length: int = LENGTH) -> list[list[Part]]:
    """The same ids in fewer sequences: the emptiest fill the gaps of the others, and one that stays unfilled is cut at powers of two."""
    used = [sum(n for _, _, n in parts) for parts in packed]
    order = sorted((i for i in range(len(packed)) if length - used[i] >= least_gap), key=lambda i: (used[i], i))
    out = [parts for i, parts in enumerate(packed) if length - used[i] < least_gap]
    at, to = 0, len(order) - 1
    while at < to:
        giver, taker = packed[order[at]], packed[order[to]]
        gap = length - used[order[to]]
        while gap and giver:
            piece, first, n = giver.pop()
            taken = min(gap, n)
            if taken < n:
                giver.append((piece, first, n - taken))
            taker.append((piece, first + n - taken, taken))
            gap -= taken
            used[order[at]] -= taken
            used[order[to]] += taken
        if not gap:
            out.append(taker)
            to -= 1
        if not giver:
            at += 1
    if at == to and at < len(order):
        rest = packed[order[at]]
        total = sum(n for _, _, n in rest)
        if length - total < least_gap:
            return [*out, rest]
        while rest:
            room, sequence = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                piece, first, n = rest.pop(0)
                taken = min(room, n)
                if taken < n:
                    rest.insert(0, (piece, first + taken, n - taken))
                sequence.append((piece, first, taken))
                room -= taken
            out.append(sequence)
    return out


def pack(df: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of each piece.

    Sequences have ``LENGTH`` ids, or fewer: a few per group at powers of two, others short by less than ``LEAST_GAP``.
    """
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("bigint"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    pieces = _cut(df, path, id_col, text)
    # Any piece may go anywhere, also those of rows that are equal in all columns.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups))).drop("row")
    schema = T.StructType([dealt.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in (*_PIECES, "sequence_id", "offset"))])

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        start, length, crc, tokens = (table[c].to_pylist() for c in _PIECES)
        doc, ids = table["doc_id"].to_pylist(), table["ids"].to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (-length[i], crc[i], str(doc[i]), start[i], tokens[i], ids[i] or b""))
        packed = [[(order[i], 0, length[order[i]]) for i in parts] for parts in first_fit([length[i] for i in order])]
        which, rows = [], []
        for number, parts in enumerate(filled(packed)):
            offset = 0
            for i, first, n in parts:
                whole = n == length[i]
                which.append(i)
                rows.append((start[i] + first, n, crc[i] if whole else zlib.crc32(ids[i][4 * first : 4 * (first + n)]), tokens[i], (key[0].as_py() << 32) + number, offset))
                offset += n
        made = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.Table.from_arrays([table["doc_id"].take(pa.array(which, pa.int64())), *made], names=schema.names)

    return dealt.groupBy("group").applyInArrow(work, schema)
