"""Near duplicates by DartMinHash signatures of weighted word shingles.

A text is the multiset of its shingles of five words (of all its words, if it has fewer).  Each unit
of a shingle's weight is a strip on which hashed darts fall, the same in every text that has the strip:
a Poisson number for each band of ranks, bands doubling in height.  A text reads the bands up to a
height at which about k ln k + 2k darts have fallen, so that nearly all of its k coordinates have
one; texts with an empty coordinate read on.  The least rank per coordinate is the signature; two texts
agree on a coordinate with the probability of their weighted Jaccard similarity.

Signatures are joined by bands of coordinates: at similarity 0.8, 32 bands of five miss a pair with a
chance of 3e-6.  Texts are joined once per distinct text.  In a bucket each text is compared with
the least one; where a bucket then still holds several classes, with the one nearest to the others,
and in the end all texts of different classes that can be alike are compared.  So no link between classes is
lost, and no class is expanded into pairs.  Pairs are ruled out only by bounds that hold for every pair:
units that no other text has, and parities of hashed units.  Every link is verified on the exact multisets.

Nulls: null texts, and texts without words unless equal, are alone in their class; a null id makes a
class without a name if it is alone.  Very long texts are whole rows.  Repeated rows are copies of
each other.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import Words, annotate, lookup, mixed, staged
from lumberline.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 5
#: Words of 64 parities that bound from below how many units two texts do not share.
PARITY_WORDS = 16
#: Ranks up to 2 ** LOWEST make the first band.
LOWEST = -4
_UNIT, _BAND, _DART, _PLACE = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice of texts, and the row of each, in row order."""
    hashes, rows = words.hashes(), words.rows()
    grams, at = words.grams(hashes, n)
    counts = np.diff(words.row_starts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return grams, rows[at]
    lone = np.zeros(len(short), np.uint64)
    for i in range(n):
        there = counts[short] > i
        lone[there] = mixed(lone[there] + hashes[words.row_starts[short[there]] + i] + np.uint64(i + 1))
    grams, rows = np.concatenate([grams, lone]), np.concatenate([rows[at], short])
    order = np.argsort(rows, kind="stable")
    return grams[order], rows[order]


def _poisson_steps(mean: float) -> np.ndarray:
    """64-bit thresholds: a uniform number above the first i of them means more than i darts."""
    top = int(mean + 12 * mean**0.5 + 30)
    terms = np.exp([i * log(mean) - mean - lgamma(i + 1) for i in range(top)])
    below = np.minimum(np.cumsum(terms), 1 - 2.0**-53)
    return (below * 2.0**64).astype(np.uint64)


def _height(band: int) -> tuple[float, float]:
    return (0.0 if band == 0 else 2.0 ** (LOWEST + band - 1)), 2.0 ** (LOWEST + band)


def signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """The least ranks per row and coordinate; infinite for rows without elements.  ``rows`` ascend."""
    out = np.full(n_rows * k, np.inf)
    if not len(elements):
        return out.reshape(n_rows, k)
    # 44 bits of a shingle are enough to tell shingles of one text apart.
    keyed = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (elements >> np.uint64(20)))
    rows, place = (keyed >> np.uint64(44)).astype(np.int64), np.arange(len(keyed))
    new = np.append(True, keyed[1:] != keyed[:-1])
    unit = place - np.maximum.accumulate(np.where(new, place, 0))
    strips = mixed((keyed & np.uint64((1 << 44) - 1)) + unit.astype(np.uint64) * _UNIT)
    weight = np.bincount(rows, minlength=n_rows)
    wanted = k * log(k) + 2 * k
    with np.errstate(divide="ignore"):
        level = np.maximum(0, np.ceil(np.log2(wanted / weight)) - LOWEST)
    level[weight == 0] = -1
    band = 0
    while True:
        reading = level >= band
        if not reading.any():
            break
        mine = strips if reading[weight > 0].all() else strips[reading[rows]]
        whose = rows if len(mine) == len(strips) else rows[reading[rows]]
        low, high = _height(band)
        steps = _poisson_steps(high - low)
        drawn = mixed(mine ^ np.uint64(int(_BAND) * (band + 1) % 2**64))
        some = np.flatnonzero(drawn >= steps[0])
        n_darts = np.searchsorted(steps, drawn[some], "right")
        darts = np.repeat(some, n_darts)
        number = np.arange(len(darts)) - np.repeat(np.cumsum(n_darts) - n_darts, n_darts)
        hashed = mixed(drawn[darts] + (number + 1).astype(np.uint64) * _DART)
        rank = low + (high - low) * ((hashed >> np.uint64(11)) * 2.0**-53)
        coordinate = ((mixed(hashed ^ _PLACE) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        np.minimum.at(out, whose[darts] * k + coordinate.astype(np.int64), rank)
        band += 1
        # Rows that have read their bands and still miss a coordinate read one more.
        due = np.flatnonzero(level == band - 1)
        if len(due):
            level[due[np.isinf(out.reshape(n_rows, k)[due]).any(axis=1)]] = band
    return out.reshape(n_rows, k)


def _band_hashes(texts: pa.Array, bands: int, band_rows: int) -> list[pa.Array]:
    words = Words(texts)
    grams, rows = shingles(words)
    n = len(texts)
    signature = signatures(grams, rows, n, bands * band_rows).view(np.uint64).reshape(n, bands, band_rows)
    hashed = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(band_rows):
        hashed = mixed(hashed * _UNIT + signature[:, :, i])
    weight = np.bincount(rows, minlength=n)
    counts = np.where(weight > 0, bands, 0)
    kept = hashed[weight > 0].ravel().view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(kept, pa.int64()))
    return [pa.array(weight, pa.int64()), lists]


def _shingle_sets(texts: pa.Array) -> list[pa.Array]:
    """The sorted shingles of each text, and the parities of its units: how many hash to each bit, modulo 2."""
    grams, rows = shingles(Words(texts))
    order = np.lexsort((grams, rows))
    ends = np.searchsorted(rows, np.arange(len(texts) + 1)) * 8
    data = grams[order].tobytes()
    bits, parities = 64 * PARITY_WORDS, np.zeros(len(texts) * PARITY_WORDS, np.uint64)
    place = rows.astype(np.int64) * bits + (grams % np.uint64(bits)).astype(np.int64)
    np.bitwise_xor.at(parities, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * PARITY_WORDS, pa.int32()), pa.array(parities.view(np.int64), pa.int64()))
    return [pa.array([data[a:b] for a, b in zip(ends.tolist(), ends.tolist()[1:])], pa.binary()), lists]


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted multisets of 64-bit numbers."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    (x, m), (y, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    either = int(m.sum() + n.sum()) - both
    return both / either if either else 0.0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of at least that similarity; ``sets`` has one row per node."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x"), batch.column("y"), strict=True)
            near = [weighted_jaccard(x.as_buffer(), y.as_buffer()) >= similarity for x, y in pairs]
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("weight").alias("wx")), "a")
    second = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("weight").alias("wy")), "b")
    sized = second.where(F.least("wx", "wy") >= F.greatest("wx", "wy") * F.lit(similarity))
    return sized.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _own_units(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, own, own_parity)``: how many units of a text's shingles occur in no other of the nodes, and their parities."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum([len(x.as_buffer()) // 8 for x in batch.column("shingles")]))
            every = np.frombuffer(b"".join(x.as_py() for x in batch.column("shingles")), np.int64)
            node = np.repeat(np.asarray(batch.column("node")), np.diff(ends))
            first = np.flatnonzero(np.append(True, (every[1:] != every[:-1]) | (node[1:] != node[:-1]))) if len(every) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[first]), pa.array(node[first]), pa.array(np.diff(np.append(first, len(every))))], names=["shingle", "node", "n"])

    listed = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(units, "shingle bigint, node bigint, n bigint")
    alone = listed.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.sum("n").alias("n")).where("node = other")
    bits = 64 * PARITY_WORDS - 1
    words = [F.expr(f"bit_xor(if(n % 2 = 1 and shiftright(shingle & {bits}, 6) = {i}, shiftleft(1L, int(shingle & 63)), 0L))") for i in range(PARITY_WORDS)]
    return alone.groupBy("node").agg(F.sum("n").alias("own"), F.array(*words).alias("own_parity"))


def _open_buckets(members: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets with several classes and more than the one compared pair: ``(bucket, node, weight, buckets, core, parity)``.

    ``core`` leaves out the units of a text that no other of these texts has; two texts share at most
    the lesser core, and differ in one unit of the core at least wherever their parities differ.
    """
    state = _classed(members, label).groupBy("bucket").agg(F.count("*").alias("n"), (F.min("class") != F.max("class")).alias("open"))
    left = staged(members.select("bucket", "node", "weight").join(state.where("open and n > 2").select("bucket"), "bucket"), "open-buckets")
    # At most as many buckets per text as there are bands.
    facts = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(sets.select("node", "parity"), "node")
    facts = facts.join(_own_units(left.select("node").distinct(), sets), "node", "left")
    kept = F.when(F.col("own_parity").isNull(), F.col("parity")).otherwise(F.zip_with("parity", "own_parity", lambda x, y: x.bitwiseXOR(y)))
    facts = facts.select("node", "buckets", F.coalesce("own", F.lit(0)).alias("own"), kept.alias("parity"))
    return staged(left.join(facts, "node").withColumn("core", F.col("weight") - F.col("own")).drop("own"), "open-buckets")


def _classed(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")


def _pairs_between_classes(cored: DataFrame, label: DataFrame, similarity: float, with_middle: bool) -> DataFrame:
    """Pairs of one bucket but different classes that can still be links: with the text nearest to all others, or all.

    The bounds of the cores and parities sort out most texts that are unlike the middle of their group, since these
    are unlike everything else as well.
    """
    of = _classed(cored, label)
    per_class = of.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.min(F.struct(1 - F.col("core") / F.col("weight"), "node", "weight", "core", "class", "parity")).alias("middle"))
    state = per_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class"))["class"].alias("main"), F.min("middle").alias("middle")).where("classes > 1")
    left = of.join(state.drop("classes"), "bucket")
    if with_middle:
        side = lambda c: F.col(f"middle.{c}")
        met = left.select("node", "weight", "core", "class", F.col("parity").alias("pa"), *(side(c).alias(n) for c, n in (("node", "b"), ("weight", "wb"), ("core", "ob"), ("class", "cb"), ("parity", "pb"))))
        met = met.withColumnsRenamed({"node": "a", "weight": "wa", "core": "oa", "class": "ca"}).where("ca <> cb").where(_possible(similarity))
    else:
        x = left.where("class <> main").select(F.col("bucket").alias("__bucket"), F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("core").alias("oa"), F.col("class").alias("ca"), F.col("buckets").alias("ba"), F.col("parity").alias("pa"))
        y = left.select("bucket", "main", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("core").alias("ob"), F.col("class").alias("cb"), F.col("buckets").alias("bb"), F.col("parity").alias("pb"))
        # A pair that shares several buckets is met in the first of them.
        first = F.array_min(F.array_intersect("ba", "bb")) == F.col("bucket")
        once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("ca") < F.col("cb")))
        met = x.join(y, (F.col("__bucket") == F.col("bucket")) & once & _possible(similarity) & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(similarity: float) -> Column:
    """Whether two texts can be that similar, given how many units at least only one of them has."""
    apart = F.abs(F.col("oa") - F.col("ob"))
    parities = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, more: n + more)
    total = F.col("wa") + F.col("wb")
    most = total * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    own = total - F.col("oa") - F.col("ob")
    return (own + apart <= most) & (own + parities <= most)


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """``(doc_id, class_id, text_key, kept)``: the class of each row is named by its least id; one row per class is kept."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = source.withColumn("text_key", F.md5(F.col("text").cast("binary"))).withColumn("tag", F.monotonically_increasing_id())

    def prepare() -> Callable[[pa.Array], list]:
        return lambda texts: _band_hashes(texts, bands, band_rows)

    signed = staged(annotate(keyed, [("weight", "bigint"), ("buckets", "array<bigint>")], prepare, carry=("doc_id", "text_key", "tag")), "signatures")
    # One node per distinct text, named by a row of it.  A null text is a node for each row.
    node_key = F.coalesce("text_key", F.concat(F.lit("row "), F.col("tag").cast("string")))
    rows = signed.select("doc_id", node_key.alias("key"), "tag", "weight")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("tag").alias("t"))
    nodes = staged(rows.groupBy("key").agg(F.min(order).alias("head"), F.count("*").alias("n"), F.first("weight").alias("weight")), "nodes")
    heads = nodes.where("weight > 0").select(F.col("head.t").alias("node"))
    placed = staged(
        signed.select(F.col("tag").alias("node"), "weight", "buckets").join(heads, "node", "left_semi").select("node", "weight", F.explode("buckets").alias("bucket")), "buckets"
    )
    shared = placed.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = staged(placed.join(shared.select("bucket", "center"), "bucket"), "shared-buckets")

    # The exact multisets of texts that share a bucket, from one row of each text.
    wanted = members.select("node").distinct().join(nodes.select(F.col("head.t").alias("node"), F.col("head.d").alias("d"), "key", "weight"), "node")
    texts = keyed.join(wanted.withColumnRenamed("weight", "w"), (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("d")))
    made = annotate(texts, [("shingles", "binary"), ("parity", "array<bigint>")], lambda: _shingle_sets, carry=("node", "w"))
    sets = staged(made.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity"), F.first("w").alias("weight")), "shingle-sets")

    tried = staged(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = staged(_verified(tried, sets, similarity), "links")
    label = components(links)
    cored = _open_buckets(members, sets, label)
    for with_middle in () if cored.isEmpty() else (True, False):
        met = _pairs_between_classes(cored, label, similarity, with_middle)
        more = staged(met.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = staged(_verified(more, sets, similarity), "links")
        if not found.isEmpty():
            links = links.union(found)
            label = components(links)
        tried = tried.union(more)
    named = nodes.select("key", "n", F.col("head.t").alias("node"), "head").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("head").alias("first"))
    classes = named.join(firsts, "component").select("key", F.col("n"), F.col("first.d").alias("class_id"), F.col("first.t").alias("kept_tag"))
    found = lookup(rows, classes, "key", "n")
    return found.select(F.col("doc_id").alias(id_col), "class_id", F.col("key").alias("text_key"), (F.col("tag") == F.col("kept_tag")).alias("kept"))
