"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents (``MOST_EXAMPLES``) is learned from.  Features are lower-cased words and
their beginnings; those that go with the label by a chi-squared test span the space, since the many
rare words of a text say nothing about it.  Examples are posted by feature in blocks, with the
greatest weight of each feature per block; a text reads blocks in the order of their bounds until no block
left can hold a nearer example, so that the neighbours are exact.  Votes weighted by distance are
calibrated on the examples themselves, each left out of its own vote, by isotonic regression.

Nulls: null and empty texts have no features and get the share of toxic ones among examples without
any, like all texts without features.  Null labels and ids are not learned from; of several labels
of an id the greatest counts.  Without examples every score is 0.  Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import annotate, is_training_row, mixed, runs, staged, text_bytes

#: Labelled documents that are learned from, by the order of a hash of their ids.
MOST_EXAMPLES = 20_000
MOST_FEATURES, LEAST_CHI2, LEAST_EXAMPLES = 4096, 15.0, 4
NEIGHBOURS, BLOCK, PREFIXES = 15, 64, (4, 5, 6)
#: Texts that are looked up side by side.
QUERIES = 256
THRESHOLD = 0.3

_INSIDE = np.ones(256, bool)
_INSIDE[[c for c in range(128) if not (97 <= c < 123)]] = False


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row, in row order: row, feature, how often."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    inside = _INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts], closes[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, lengths = np.searchsorted(offsets, starts, "right") - 1, ends - starts
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    # The first eight bytes as one number; longer words add the rest, eight bytes at a time.
    head = np.zeros(len(starts), np.uint64)
    prefixes = {}
    for i in range(8):
        there = lengths > i
        head = (head << np.uint64(8)) | np.where(there, padded[starts + i], 0)
        if i + 1 in PREFIXES:
            longer = lengths > i + 1
            prefixes[i + 1] = (row[longer], mixed(head[longer] + np.uint64(i + 1)))
    word, at = mixed(head), 8
    rest = np.flatnonzero(lengths > at)
    while len(rest):
        word[rest] = mixed(word[rest] * np.uint64(31) + padded[np.minimum(starts[rest] + at, len(data))])
        at += 1
        rest = rest[lengths[rest] > at]
    rows = np.concatenate([row, *(r for r, _ in prefixes.values())])
    features = np.concatenate([word, *(f for _, f in prefixes.values())])
    return rows, features, np.ones(len(rows), np.int64)


def _distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (features[1:] != features[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], features[first], np.diff(np.append(first, len(rows)))


@dataclass
class Vectors:
    """Sparse unit vectors: row i has the entries ends[i] to ends[i + 1]."""

    ends: np.ndarray
    number: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        lengths = self.ends[rows + 1] - self.ends[rows]
        ends = np.append(0, np.cumsum(lengths))
        at = np.repeat(self.ends[rows] - ends[:-1], lengths) + np.arange(ends[-1])
        return Vectors(ends, self.number[at], self.weight[at])

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self), width), np.float32)
        out[np.repeat(np.arange(len(self)), np.diff(self.ends)), self.number] = self.weight
        return out


@dataclass
class Index:
    """Examples as unit vectors, posted in blocks with the greatest weight of each feature, and what turns votes into scores."""

    features: np.ndarray  # sorted hashes
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    posted: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by block: its features, their weights by example
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # feature by block
    base: float = 0.0
    without: float = 0.0  # share of toxic examples among those without features
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vectors(self, texts: pa.Array) -> Vectors:
        """For each text its features' numbers and weights, of length one."""
        rows, hashes, _ = _features(texts)
        if len(self.features) and len(rows):
            at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            known = self.features[at] == hashes
            rows, number, often = _distinct(rows[known], at[known])
        else:
            rows, number, often = (np.zeros(0, np.int64),) * 3
        weight = (1 + np.log(np.maximum(often, 1))) * self.idf[number]
        length = np.sqrt(np.bincount(rows, weight * weight, minlength=len(texts)))
        return Vectors(np.searchsorted(rows, np.arange(len(texts) + 1)), number, weight / length[rows])

    def post(self, examples: Vectors) -> None:
        n_blocks = -(-len(examples) // BLOCK)
        self.block_max = np.zeros((len(self.features), n_blocks), np.float32)
        for block in range(n_blocks):
            own = examples.take(np.arange(block * BLOCK, min(len(examples), (block + 1) * BLOCK)))
            present = np.unique(own.number)
            weights = own.dense(len(self.features))[:, present].T
            self.posted.append((present, np.ascontiguousarray(weights)))
            self.block_max[present, block] = weights.max(axis=1)

    def nearest(self, queries: Vectors, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query its nearest examples and their cosines, exact, ties by number; cosines of 0 are no neighbours."""
        dense = queries.dense(len(self.features))
        bound = dense @ self.block_max
        # A neighbour as one number: the cosine first, then the smaller example.
        best = np.zeros((len(queries), NEIGHBOURS), np.int64)
        for block in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            least = (best[:, 0] >> _ID_BITS) / _COSINE_STEPS
            # A block whose bound is below the least neighbour so far holds none.
            open_ = np.flatnonzero((bound[:, block] > 0) & (bound[:, block] + 1e-5 >= least))
            if not len(open_):
                continue
            present, weights = self.posted[block]
            cosine = dense[np.ix_(open_, present)] @ weights
            example = block * BLOCK + np.arange(weights.shape[1])
            key = (np.round(cosine * _COSINE_STEPS).astype(np.int64) << _ID_BITS) | (_IDS - example)
            key[cosine <= 0] = 0
            if leave_out is not None:
                key[example[None, :] == leave_out[open_, None]] = 0
            best[open_] = np.sort(np.concatenate([best[open_], key], axis=1), axis=1)[:, -NEIGHBOURS:]
        best = best[:, ::-1]
        return np.where(best > 0, _IDS - (best & _IDS), -1), np.where(best > 0, (best >> _ID_BITS) / _COSINE_STEPS, 0.0)

    def vote(self, best: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Votes weighted by one over the distance, with one vote for the base rate."""
        weight = np.where(best >= 0, 1 / (0.05 + 1 - np.minimum(near, 1)), 0)
        return ((weight * self.toxic[best]).sum(axis=1) + self.base) / (weight.sum(axis=1) + 1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, self.knots, self.levels) if len(self.knots) else votes, 0, 1)


_ID_BITS, _COSINE_STEPS = 32, 1 << 20
_IDS = (1 << _ID_BITS) - 1


def _isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps nearest to the labels, by pooling neighbours that fall."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([y, 1.0, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2], high]
    knots = np.array([x for p in pools for x in (p[2], p[3])])
    levels = np.array([p[0] / p[1] for p in pools for _ in range(2)])
    return knots, levels


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text: str, most: int) -> DataFrame:
    """``(id, toxic, text)`` of the sample.  Its ids are bounded in number and travel to the documents."""
    given = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & is_training_row(F.col("doc_id")))
    one = given.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = texts.join(F.broadcast(one), "id").select(F.col("id").cast("bigint").alias("id"), "toxic", F.coalesce("text", F.lit("")).alias("text"))
    # One text per id, so that the bound holds for repeated rows as well.
    return found.groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))


def _selected(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The features that go with the label, their inverse document frequencies, and the numbers of all and of toxic examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in runs(batch, "text", 8 << 20):
                toxic = np.asarray(piece.column("toxic")).astype(np.int64)
                rows, hashes, _ = _features(piece.column("text"))
                rows, hashes, _ = _distinct(rows, hashes)
                order = np.argsort(hashes, kind="stable")
                hashes, bad = hashes[order], toxic[rows[order]]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(hashes)))
                bad = np.add.reduceat(bad, first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(n), pa.array(bad)], names=["feature", "n", "bad"])

    total = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    c, d = F.lit(total.bad) - a, F.lit(total.n - total.bad) - b
    chi2 = F.lit(float(total.n)) * F.pow(a * d - b * c, 2) / F.greatest(F.lit(1.0), (a + b) * (c + d) * (a + c) * (b + d).cast("double"))
    counted = examples.select("toxic", "text").mapInArrow(count, "feature bigint, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    best = counted.where(F.col("n") >= LEAST_EXAMPLES).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "feature").limit(MOST_FEATURES).collect()
    found = sorted((r.feature & (2**64 - 1), r.n) for r in best)
    features, n = np.array([f for f, _ in found], np.uint64), np.array([c for _, c in found], np.float64)
    return features, np.log(1 + total.n / np.maximum(n, 1)), total.n, total.bad


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", most: int = MOST_EXAMPLES) -> Index:
    """The index over a sample of at most ``most`` labelled documents."""
    spark = docs.sparkSession
    examples = staged(_examples(docs, labels, id_col, text, most), "toxicity-examples")
    features, idf, n, bad = _selected(examples)
    index = Index(features, idf, base=(bad + 1) / (n + 2) if n else 0.0)
    if not n:
        return index
    shared = spark.sparkContext.broadcast(index)

    def prepare() -> Callable[[pa.Array], list]:
        def compute(texts: pa.Array) -> list:
            made = shared.value.vectors(texts)
            ends = pa.array(made.ends, pa.int32())
            return [pa.ListArray.from_arrays(ends, pa.array(made.number, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(made.weight, pa.float64()))]

        return compute

    made = annotate(examples, [("number", "array<bigint>"), ("weight", "array<double>")], prepare, carry=("id", "toxic"))
    made = staged(made, "toxicity-vectors")
    lean = made.where(F.size("number") == 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    index.without = (lean.bad + index.base) / (lean.n + 1)
    # Sparse vectors of at most as many examples as were sampled; like ones stand in one block.
    strongest = F.element_at("number", F.array_position("weight", F.array_max("weight")).cast("int"))
    rows = made.where(F.size("number") > 0).withColumn("first", strongest).orderBy("toxic", "first", "id").toArrow().combine_chunks()
    index.ids, index.toxic = np.asarray(rows["id"]).astype(np.int64), np.asarray(rows["toxic"]).astype(np.int64)
    if not rows.num_rows:
        return index
    lists = rows["number"].combine_chunks()
    vectors = Vectors(np.append(0, np.cumsum(np.asarray(lists.value_lengths()))), np.asarray(lists.flatten()), np.asarray(rows["weight"].combine_chunks().flatten()))
    index.post(vectors)
    ready = spark.sparkContext.broadcast((index, vectors))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = ready.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                which = np.asarray(batch.column("id").slice(at, QUERIES))
                votes = index.vote(*index.nearest(vectors.take(which), which))
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(votes, pa.float64())], names=["id", "vote"])

    votes = spark.range(len(vectors)).mapInArrow(left_out, "id bigint, vote double").toArrow()
    index.knots, index.levels = _isotonic(np.asarray(votes["vote"]), index.toxic[np.asarray(votes["id"])])
    return index


def toxicity(df: DataFrame, index: Index, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` and ``evidence``: the neighbours' ids, their similarity and their labels."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def prepare() -> Callable[[pa.Array], list]:
        index: Index = shared.value

        def compute(texts: pa.Array) -> list:
            vectors = index.vectors(texts)
            score = np.full(len(vectors), index.without)
            told = np.flatnonzero(np.diff(vectors.ends)) if len(index.ids) else np.zeros(0, np.int64)
            found, near, counts = [], [], np.zeros(len(vectors), np.int64)
            for at in range(0, len(told), QUERIES):
                some = told[at : at + QUERIES]
                best, cosine = index.nearest(vectors.take(some))
                score[some] = index.calibrated(index.vote(best, cosine))
                found.append(best[best >= 0])
                near.append(cosine[best >= 0])
                counts[some] = (best >= 0).sum(axis=1)
            best = np.concatenate(found) if found else np.zeros(0, np.int64)
            cosine = np.concatenate(near) if near else np.zeros(0)
            evidence = pa.StructArray.from_arrays(
                [pa.array(index.ids[best], pa.int64()), pa.array(cosine, pa.float64()), pa.array(index.toxic[best], pa.int32())], names=["doc_id", "similarity", "toxic"]
            )
            return [pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), evidence)]

        return compute

    return annotate(df, [("score", "double"), ("evidence", "array<struct<doc_id:bigint,similarity:double,toxic:int>>")], prepare, text=text, carry=carry)
