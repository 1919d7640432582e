"""Connected components of a graph of links, by alternating stars over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import staged


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: those above the node, or those below and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        below = both.where("b < a")
        least = below.groupBy("a").agg(F.min("b").alias("m"))
        moved = below.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Graphs of up to so many links are one partition, which needs no rounds.
SMALL = 200_000
#: A partition is contracted each time it has read so many links.
CHUNK = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node that these links connect it with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes, each partition's as stars; a single partition's are the components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, n = [(a, b)], 0
        for batch in batches:
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
            n += batch.num_rows
            if n > CHUNK:
                held, n = [_forest(*map(np.concatenate, zip(*held)))], 0
        a, b = _forest(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(work, "a bigint, b bigint")


def _round(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Write links; how many there are, and a sum that changes with them."""
    links = staged(links, "links")
    n, total = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return links, (n, total)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is named by its least node.

    Each partition's links become stars at once.  What is left is one partition if it is small; otherwise
    rounds write tables, and end when little is left or a round changes nothing, after about the
    logarithm of the longest path.
    """
    links, before = _round(_contracted(links.where("a <> b")).distinct())
    while before[0] > SMALL:
        links, after = _round(_star(_star(links, True), False))
        if after == before:
            break
        before = after
    else:
        links = staged(_contracted(links.coalesce(1)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
