"""Byte-level BPE with vectorised pre-tokenisation, cached pair merging, and offsets kept for decoding.

Texts become arrays of codepoint classes.  A small automaton says where the pieces of the usual
pattern begin; since running it over a stretch of text is a function from state to state, and such
functions compose associatively, blocks of all texts of a batch are scanned side by side and then
chained.  Pieces are slices of the text; each distinct one is merged once per worker and looked up
after that.

Nulls are empty texts and have no ids.  Very long texts are whole rows of a batch, scanned like any
other.  Repeated rows, and columns whose names clash with the new ones, do no harm: new columns win.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumberline.llm.common import annotate, text_bytes

# Classes of codepoints, with what their neighbours tell.
LETTER, DIGIT, OTHER, GLUE, BLANK, LAST, SHORT, LONG = range(8)
# GLUE: a space before a visible character.  LAST: other white space before one.  BLANK: white space before more of it
# or the end.  SHORT and LONG: an apostrophe before one or two letters of a contraction.
FRESH = 8  # added to the class of the first codepoint of a text

# States: what the piece so far allows.
_DONE, _LETTERS, _DIGITS, _OTHERS, _GLUED, _BLANKS, _TWO_LEFT, _ONE_LEFT = range(8)


def _rule(state: int, kind: int) -> tuple[int, bool]:
    """The state after a codepoint, and whether a piece begins at it."""
    if kind >= FRESH:
        return _rule(_DONE, kind - FRESH)
    if state == _TWO_LEFT:
        return _ONE_LEFT, False
    if state == _ONE_LEFT:
        return _DONE, False
    grows = {LETTER: _LETTERS, DIGIT: _DIGITS, OTHER: _OTHERS, SHORT: _OTHERS, LONG: _OTHERS}
    if kind in grows and state in (grows[kind], _GLUED):
        return grows[kind], False
    if kind == BLANK and state == _BLANKS:
        return _BLANKS, False
    begins = {LETTER: _LETTERS, DIGIT: _DIGITS, OTHER: _OTHERS, GLUE: _GLUED, BLANK: _BLANKS, LAST: _DONE, SHORT: _ONE_LEFT, LONG: _TWO_LEFT}
    return begins[kind], True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``composed[f * 16 + class]``: the function f, then the class; ``applied[f]``: states after f; and per state and class, next state and flag."""
    n_classes = 2 * FRESH
    step = np.array([[_rule(s, k)[0] for k in range(n_classes)] for s in range(8)], np.uint8)
    flag = np.array([[_rule(s, k)[1] for k in range(n_classes)] for s in range(8)], bool)
    functions, rows, at = {tuple(range(8)): 0}, [], 0
    order = [tuple(range(8))]
    while at < len(order):  # all functions that stretches of text can have
        row = []
        for kind in range(n_classes):
            after = tuple(int(step[s, kind]) for s in order[at])
            if after not in functions:
                functions[after] = len(order)
                order.append(after)
            row.append(functions[after])
        rows.append(row)
        at += 1
    return np.array(rows, np.uint16).ravel(), np.array(order, np.uint8), step.ravel(), flag.ravel()


SCAN_BLOCK = 64


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each codepoint, from the classes."""
    composed, applied, step, flag = automaton()
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // SCAN_BLOCK)
    grid = np.full(blocks * SCAN_BLOCK, LETTER, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(blocks, SCAN_BLOCK).T)
    # The function of each block, all blocks at once.
    function = np.zeros(blocks, np.uint16)
    for kinds in grid:
        function = composed[function * np.uint16(2 * FRESH) + kinds]
    # The state before each block: one table look-up per block.
    state, before = 0, np.empty(blocks, np.uint8)
    for i, row in enumerate(applied[function].tolist()):
        before[i] = state
        state = row[state]
    starts = np.empty((SCAN_BLOCK, blocks), bool)
    state = before
    for i, kinds in enumerate(grid):
        place = (state << np.uint8(4)) | kinds
        starts[i] = flag[place]
        state = step[place]
    return starts.T.ravel()[:n]


class Classes:
    """Codepoint classes as the pattern's own engine has them: which codepoints are letters, numbers, white space."""

    def __init__(self, members: Callable[[str], str]):
        self.table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", BLANK)):
            self.table[np.frombuffer(members(pattern).encode("utf-32-le"), np.uint32)] = kind

    def __call__(self, points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Classes of the codepoints of several texts; ``row_starts`` has the first codepoint of each, and the end."""
        n = len(points)
        kinds = self.table[points]
        after = np.zeros(n, bool)  # whether there is a next codepoint in the text
        after[:-1] = True
        inner = row_starts[1:-1]
        after[inner[inner > 0] - 1] = False
        blank = kinds == BLANK
        shown = np.zeros(n, bool)
        shown[:-1] = ~blank[1:]
        before_shown = blank & shown & after
        kinds[before_shown] = np.where(points[before_shown] == 32, GLUE, LAST)
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            ends = row_starts[np.searchsorted(row_starts, quotes, "right")]
            padded = np.append(points, [0, 0])
            one = np.where(quotes + 1 < ends, padded[quotes + 1], 0)
            two = np.where(quotes + 2 < ends, padded[quotes + 2], 0)
            kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
            pair = one * 128 + np.where(two < 128, two, 0)
            kinds[quotes[(one < 128) & np.isin(pair, [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
        firsts = row_starts[:-1]
        kinds[firsts[firsts < row_starts[1:]]] += FRESH
        return kinds


_ALL = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def pieces(texts: pa.Array, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, the byte where each piece begins, and the first piece of each text (and the end)."""
    data, offsets = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80) if len(points) < len(data) else np.arange(len(data))
    row_starts = np.searchsorted(heads, offsets)
    begins = heads[np.flatnonzero(piece_starts(classes(points, row_starts)))]
    return data, begins, np.searchsorted(begins, offsets)


class Cache:
    """Pieces met so far, numbered, with the ids of each; emptied when it has grown to its bound."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 250_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.counts, self.starts, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 13, np.uint32)
        self.size = self.used = 0

    def __call__(self, slices: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        if self.size > self.most:
            self._clear()
        coded = slices.dictionary_encode()
        data, edges = text_bytes(coded.dictionary)
        whole, edges, known = data.tobytes(), edges.tolist(), self.number
        distinct = [whole[a:b] for a, b in zip(edges, edges[1:])]
        numbers = list(map(known.get, distinct))
        new = [s for s, number in zip(distinct, numbers) if number is None]
        if new:
            found = self.encode(new)
            known.update(zip(new, range(self.size, self.size + len(new)), strict=True))
            counts = np.fromiter(map(len, found), np.int32, len(found))
            ids = np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum()))
            self.starts = _appended(self.starts, self.size, self.used + np.cumsum(counts, dtype=np.int64) - counts)
            self.counts = _appended(self.counts, self.size, counts)
            self.ids = _appended(self.ids, self.used, ids)
            self.size += len(new)
            self.used += len(ids)
            numbers = list(map(known.get, distinct))
        which = np.array(numbers, np.int64)[np.asarray(coded.indices)]
        counts = self.counts[which]
        return gathered(self.ids, self.starts[which], counts), counts


def _appended(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    while len(array) < used + len(more):
        array = np.concatenate([array, np.zeros_like(array)])
    array[used : used + len(more)] = more
    return array


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + counts[i]]`` for all i, one after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


def encoded(texts: pa.Array, classes: Classes, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the first id of each text (and the end)."""
    data, begins, row_pieces = pieces(texts, classes)
    edges = np.append(begins, len(data)).astype(np.int64)
    slices = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    ids, counts = cache(slices)
    return ids, np.append(0, np.cumsum(counts, dtype=np.int64))[row_pieces]


class Ranks:
    """A vocabulary of byte strings by rank, its merges, and the bytes of its ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        words: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        shown = [b"%d," % i for i in range(len(words))]
        self.digit_lengths = np.fromiter(map(len, shown), np.int64, len(shown))
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.digits = np.frombuffer(b"".join(shown), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank is merged, leftmost first, until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == _NONE:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap and links, for pieces of any length."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, length = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or len(parts[i]) + len(parts[j]) != length or ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return gathered(self.bytes, self.starts[ids], self.lengths[ids])


_NONE = 1 << 60


@lru_cache(maxsize=2)
def _codec(path: str) -> tuple[Ranks, Classes, Cache]:
    """Once per worker: the vocabulary, the classes of the library's own engine, and the cache of pieces."""
    import tiktoken

    ranks = Ranks(path)
    plain = {bytes([i]): i for i in range(256)}

    def members(pattern: str) -> str:
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=plain, special_tokens={}).encode_ordinary(_ALL)
        return bytes(found).decode("utf-8")

    return ranks, Classes(members), Cache(lambda new: [ranks.merge(p) for p in new])


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, path: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``ids`` and ``ends``: the ids of each text, and the byte of the text at which each id ends."""

    def prepare() -> Callable[[pa.Array], list]:
        ranks, classes, cache = _codec(path)

        def compute(texts: pa.Array) -> list:
            ids, starts = encoded(texts, classes, cache)
            ends = np.cumsum(ranks.lengths[ids])
            at = np.append(0, ends)[starts[:-1]]
            return [_lists(ids, starts, pa.int32()), _lists(ends - np.repeat(at, np.diff(starts)), starts, pa.int64())]

        return compute

    return annotate(df, [("ids", "array<int>"), ("ends", "array<bigint>")], prepare, text=text, carry=carry)


def decode(df: DataFrame, path: str, *, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``decoded``: the bytes of each list of ids.  A null list is empty."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    kept = [c for c in carry if c.lower() != "decoded"]
    source = df.select(*kept, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])

    def work(batches):  # noqa: ANN001, ANN202
        ranks, _, _ = _codec(path)
        for batch in batches:
            lists = batch.column("__ids")
            made = [ranks.decode(np.asarray(x.values, np.int64)).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(made, pa.binary())], names=[*kept, "decoded"])

    return source.mapInArrow(work, schema)


def round_trip(df: DataFrame, path: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes, decodes what was encoded, and adds ``n_tokens``, ``ids_sha256`` (decimal, joined by commas) and ``decoded_sha256``.

    Both steps in one pass, so that the ids need not leave the task.
    """

    def prepare() -> Callable[[pa.Array], list]:
        ranks, classes, cache = _codec(path)

        def compute(texts: pa.Array) -> list:
            ids, starts = encoded(texts, classes, cache)
            decoded, shown = ranks.decode(ids), gathered(ranks.digits, ranks.digit_starts[ids], ranks.digit_lengths[ids])
            byte_at = np.append(0, np.cumsum(ranks.lengths[ids]))[starts].tolist()
            digit_at = np.append(0, np.cumsum(ranks.digit_lengths[ids]))[starts].tolist()
            a, b = memoryview(decoded), memoryview(shown)
            return [
                pa.array(np.diff(starts), pa.int64()),
                pa.array([hashlib.sha256(b[x : max(x, y - 1)]).hexdigest() for x, y in zip(digit_at, digit_at[1:])]),
                pa.array([hashlib.sha256(a[x:y]).hexdigest() for x, y in zip(byte_at, byte_at[1:])]),
            ]

        return compute

    return annotate(df, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], prepare, text=text, carry=carry)
