"""Language identification by multilingual mixtures of byte n-grams.

Each language is a distribution over three-byte n-grams of words, counted over all documents that may be
learned from.  A document is taken for a mixture: expectation-maximisation estimates how much of it
each language gave, and the set of languages is the one with the greatest likelihood less a penalty for
each further language.  The prediction is the greatest share of that set, the score that share.

Nulls: null texts, and texts without a letter, are ``und`` with score 0; so is everything if no document
has a language.  Null languages and ids are not learned from.  Very long texts are whole rows, repeated
rows are rows of their own.  Only ids, texts and languages are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import annotate, is_training_row, runs, text_bytes

UNKNOWN = "und"
#: Entries of the model, over all languages: at most 64 MB of single-precision numbers.
MODEL_ENTRIES = 1 << 24
ITERATIONS, MOST_LANGUAGES = 8, 4
#: Overlapping n-grams tell about a third each.
PENALTY = 3.0

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] += 32
_LETTERS[[c for c in range(128) if not (97 <= c < 123 or 65 <= c < 91)]] = 0


def _grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row, in row order: row, n-gram, count."""
    data, offsets = text_bytes(texts)
    low = _LETTERS[data].astype(np.uint32)
    n = len(low) - 2
    if n <= 0:
        low = np.concatenate([low, np.zeros(2, np.uint32)])
        n = max(0, len(data))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[:n]
    # The middle byte is in a word; the others may be its borders.
    gram = (low[:n] << np.uint32(16)) | (low[1 : n + 1] << np.uint32(8)) | low[2 : n + 2]
    good = low[1 : n + 1] != 0
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    good &= np.arange(n) + 2 < ends
    hashed = (gram[good] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    keyed = np.sort((row[good].astype(np.uint64) << np.uint64(32)) | hashed)
    first = np.flatnonzero(np.append(True, keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keyed)))
    keyed = keyed[first]
    return (keyed >> np.uint64(32)).astype(np.int64), (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64), count


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # n-gram by language
    bits: int


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams of all documents that may be learned from."""
    given = docs.where(is_training_row(F.col(f"`{id_col}`"))).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    languages = sorted(r.lang for r in given.select("lang").distinct().collect())
    bits = max(8, min(16, (MODEL_ENTRIES // max(1, len(languages))).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in totals.items():
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for piece in runs(batch, "text"):
                names = piece.column("lang").dictionary_encode()
                code = np.asarray(names.indices).astype(np.int64)
                row, gram, n = _grams(piece.column("text"), bits)
                for i, name in enumerate(names.dictionary.to_pylist()):
                    mine = code[row] == i
                    total = totals.setdefault(name, np.zeros(1 << bits, np.int64))
                    total += np.bincount(gram[mine], n[mine], minlength=1 << bits).astype(np.int64)
                if len(totals) > 64:
                    yield from told()
        yield from told()

    # At most MODEL_ENTRIES rows.
    rows = given.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits, len(languages)))
    number = {name: i for i, name in enumerate(languages)}
    which = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    counts[np.asarray(rows["gram"]), which] = np.asarray(rows["n"])
    background = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * len(counts))
    smooth = 50.0
    p = (counts + smooth * background) / (counts.sum(axis=0, keepdims=True) + smooth)
    return Model(languages, np.log(p).astype(np.float32), bits)


def _mixtures(p: np.ndarray, count: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each document, and its log likelihood.  ``first``: the first n-gram of each."""
    lengths = np.diff(np.append(first, len(count)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(count, first).astype(np.float32)
    count = count.astype(np.float32)
    for turn in range(ITERATIONS + 1):
        joint = p * np.repeat(share.astype(np.float32), lengths, axis=0)
        whole = joint.sum(axis=1) + np.float32(1e-30)
        if turn == ITERATIONS:
            break
        share = np.add.reduceat(joint * (count / whole)[:, None], first) / total[:, None]
        share /= share.sum(axis=1, keepdims=True)
    return share.astype(np.float64), np.add.reduceat(count * np.log(whole), first).astype(np.float64)


def infer(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The index of the language (-1: unknown) and its share, for each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    row, gram, count = _grams(texts, model.bits)
    if not len(row) or not model.languages:
        return best, score
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    docs, n_languages = row[first], len(model.languages)
    log_p = model.log_p[gram]
    total = np.add.reduceat(count, first)
    alone = np.add.reduceat(log_p * count[:, None], first).astype(np.float64)
    # Per row of n-grams, scaled by its greatest so that rare n-grams do not vanish.
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    offset = np.add.reduceat(top[:, 0].astype(np.float64) * count, first)
    share, likelihood = _mixtures(p, count, first, np.ones((len(docs), n_languages)))
    penalty = PENALTY * np.log(total + 1.0)
    # Sets of languages in the order of their shares: one, two, and so on.
    order = np.argsort(-share, axis=1, kind="stable")
    chosen, value = alone.argmax(axis=1), alone.max(axis=1) - penalty
    part = share[np.arange(len(docs)), chosen]
    open_ = np.flatnonzero((likelihood + offset - 2 * penalty > value) & (n_languages > 1))
    for size in range(2, min(MOST_LANGUAGES, n_languages) + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), n_languages))
        np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
        lengths = np.diff(np.append(first, len(count)))[open_]
        where = np.repeat(first[open_] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        some, found = _mixtures(p[where], count[where], np.cumsum(lengths) - lengths, allowed)
        penalised = found + offset[open_] - size * penalty[open_]
        better = penalised > value[open_]
        those = open_[better]
        chosen[those], value[those] = some[better].argmax(axis=1), penalised[better]
        part[those] = some[better].max(axis=1)
        open_ = open_[better]
    best[docs], score[docs] = chosen, np.clip(part, 0.0, 1.0)
    return best, score


def _has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    folded = data | 0x20
    ascii_ = (folded >= 97) & (folded < 123) & (data < 128)
    sums = np.append(0, np.cumsum(ascii_))
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


def identify(df: DataFrame, model: Model, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def prepare() -> Callable[[pa.Array], list]:
        model = shared.value
        names = [*model.languages, UNKNOWN]

        def compute(texts: pa.Array) -> list:
            best, score = infer(texts, model)
            known = _has_letter(texts) & (len(model.languages) > 0)
            # Letters without a whole n-gram: any language as well as another.
            best = np.where(known, np.maximum(best, 0), -1)
            score = np.where(known, np.where(score > 0, score, 1.0 / max(1, len(model.languages))), 0.0)
            return [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score, pa.float64())]

        return compute

    return annotate(df, [("lang_pred", "string"), ("score", "double")], prepare, text=text, carry=carry)
