"""A Merkle manifest of a dataset: a digest per row, a 16-ary tree per source, a tree over the sources, and proofs.

Rows are ordered per source by a range sort.  A superblock is 16 ** ``height`` consecutive nodes of one tree; it
is reduced by one task to its top node, and the top nodes of all superblocks are the nodes of the next round,
so that a few rounds reach the root of a tree of any size.  On the way back the nodes of each superblock are
cogrouped with the one row of outer siblings that all its nodes share: the task finishes the local
levels, joins local and outer siblings into the proof of each row, and folds the (perhaps altered) leaf up
to the root.  No task has more than a superblock and one path.

Nulls are values of their own (``-``), a null source is a source and comes first, a null id comes first within
its source and is not tampered with.  Rows with equal ids are ordered by their leaves; rows that are equal
throughout have equal leaves side by side.  Very long texts are hashed by the JVM and leave it as
digests.  An empty table has no root and no rows.  Columns beside the five given ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.common import lookup, staged
from lumberline.llm.numbered import numbered

#: Nodes of a run, and levels that one task reduces: 4096 nodes.
ARITY, HEIGHT = 16, 3
_HEX = 64  # letters of a digest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text; null as ``-``."""

    def told(value: Column) -> Column:
        shown = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))

    return F.sha2(F.concat(*map(told, values)).cast("binary"), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as tampering leaves it: A-Z lower-cased where 5 divides the checksum of the id, else unchanged."""
    picked = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(picked, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode("ascii")).hexdigest()


def _levels(nodes: list[str], size: int, height: int) -> list[list[str]]:
    """The joined digests of the runs of each local level, up to the superblock's top or the root of a smaller tree of ``size`` nodes."""
    levels = []
    for _ in range(height):
        if size <= 1:
            break
        joined = ["".join(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        levels.append(joined)
        nodes, size = list(map(_digest, joined)), -(-size // ARITY)
    return levels


def _path(levels: list[list[str]], place: int) -> Iterator[tuple[int, str]]:
    """Of each level upwards, how many siblings stand to the left of a node's ancestor, and all of them."""
    for joined in levels:
        place, at = divmod(place, ARITY)
        run = joined[place]
        yield at, run[: at * _HEX] + run[(at + 1) * _HEX :]


def _fold(node: str, path: Sequence[tuple[int, str]]) -> str:
    for at, others in path:
        node = _digest(others[: at * _HEX] + node + others[at * _HEX :])
    return node


_NODES = "tree bigint, size bigint, place bigint, digest string"
_PATHS = "tree bigint, place bigint, subroot string, ats array<int>, others array<string>"


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY**height))


def _climb(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and the root of each tree."""
    block = ARITY**height

    def tops(group: pd.DataFrame) -> pd.DataFrame:
        own, size = group.sort_values("place")["digest"].tolist(), int(group["size"].iloc[0])
        levels = _levels(own, size, height)
        top = _digest(levels[-1][0]) if levels else own[0]
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "size": [-(-size // block)], "place": [group["place"].iloc[0] // block], "digest": [top]})

    largest = nodes.agg(F.max("size")).first()[0] or 0
    rounds, roots = [nodes], []
    while True:
        narrow = _blocked(rounds[-1].select("tree", "size", "place", "digest"), height)
        reduced = staged(narrow.groupBy("tree", "block").applyInPandas(tops, _NODES), f"{name}-tops")
        roots.append(reduced.where("size <= 1").select("tree", "digest"))
        largest = -(-largest // block)
        if largest <= 1:
            break
        rounds.append(reduced.where("size > 1"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return rounds, found


def _outer(above: pd.DataFrame) -> tuple[str, list[tuple[int, str]]]:
    row = above.iloc[0]
    return None if pd.isna(row["subroot"]) else row["subroot"], list(zip(map(int, row["ats"]), row["others"], strict=True))


def _joined(nodes: DataFrame, above: DataFrame, height: int, function: Callable, schema: str) -> DataFrame:
    """Nodes and the outer paths of their superblocks, cogrouped."""
    left = _blocked(nodes, height).groupBy("tree", "block")
    right = above.select(F.col("tree").alias("of"), F.col("place").alias("below"), "subroot", "ats", "others").groupBy("of", "below")
    return left.cogroup(right).applyInPandas(function, schema)


def _paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The whole path of each node.  Without a subroot above, the nodes are the subroots."""

    def paths(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        subroot, shared = _outer(outer)
        own = group["digest"].tolist()
        levels = _levels(own, int(group["size"].iloc[0]), height)
        found = [[*_path(levels, i), *shared] for i in range(len(own))]
        return pd.DataFrame({
            "tree": group["tree"].tolist(), "place": group["place"].tolist(), "subroot": own if subroot is None else [subroot] * len(own),
            "ats": [[at for at, _ in p] for p in found], "others": [[o for _, o in p] for p in found],
        })

    return staged(_joined(nodes.select("tree", "size", "place", "digest"), above, height, paths, _PATHS), "merkle-paths")


def _single(nodes: DataFrame, height: int) -> DataFrame:
    """The trees that end with this round: all their nodes are in one superblock."""
    return nodes.where((F.col("size") <= ARITY**height) & (F.col("place") == 0)).select("tree", F.lit(0).cast("bigint").alias("place"))


def manifest(df: DataFrame, *, columns: Sequence[str] = COLUMNS, changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row; the id keeps its name.

    ``columns``: the id, the source, and what else a leaf digests, the text last.  ``changed`` is the text
    that verification sees instead of the stored one, by default that of ``tampered``.
    """
    id_col = columns[0]
    given = [F.col(f"`{c}`") for c in columns]
    seen = tampered(given[0], given[-1]) if changed is None else changed
    honest, altered = leaf(given), leaf([*given[:-1], seen])
    # A null source is a source, the first of all.
    named = F.when(given[1].isNull(), "").otherwise(F.concat(F.lit("+"), given[1].cast("string")))
    rows = df.select(given[0].alias("__doc"), named.alias("__source"), honest.alias("digest"), F.when(~seen.eqNullSafe(given[-1]), altered).alias("altered"))
    rows = staged(rows, "merkle-leaves")

    # A tree per source, numbered in the order of the sources.
    sizes = rows.groupBy("__source").agg(F.count("*").alias("size"))
    trees = staged(numbered(sizes, [F.col("__source")], "merkle-sources", place="tree"), "merkle-trees")
    leaves = numbered(rows, [F.col("__doc").asc_nulls_first(), F.col("digest")], "merkle-order", within=["__source"])
    # The id passes through Python as text, where a null would turn whole numbers into floating ones.
    id_type = leaves.schema["__doc"].dataType
    placed = lookup(leaves, trees.withColumn("weight", F.col("size")), "__source", "weight")
    leaves = staged(placed.select("tree", "size", "place", "digest", "altered", F.col("__doc").cast("string").alias("__doc")), "merkle-placed")

    rounds, subroots = _climb(leaves, height, "merkle")
    n_trees = trees.count()
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("size"), F.col("tree").alias("place"), "digest")
    over, root = _climb(tops, height, "merkle-over")
    found = root.first()
    whole = found["digest"] if found else None

    # Back down: the path of each superblock, first over the sources, then within each.
    none = F.lit(None).cast("string")
    path = _single(over[-1], height).withColumns({"subroot": none, "ats": F.array().cast("array<int>"), "others": F.array().cast("array<string>")})
    for nodes in reversed(over):
        path = _paths(nodes, path.withColumn("subroot", none), height)
    entry = path.select(F.col("place").alias("tree"), "subroot", "ats", "others")
    path = None
    for nodes in reversed(rounds):
        ends = _single(nodes, height).join(entry, "tree")
        above = ends if path is None else path.unionByName(ends)
        if nodes is not rounds[0]:
            path = _paths(nodes, above, height)

    def proofs(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        subroot, shared = _outer(outer)
        own = group["digest"].tolist()
        levels = _levels(own, int(group["size"].iloc[0]), height)
        proof, folded = [], []
        for i, (node, other) in enumerate(zip(own, group["altered"].tolist(), strict=True)):
            path = [*_path(levels, i), *shared]
            proof.append(_digest("".join(others for _, others in path)))
            folded.append(_fold(other if isinstance(other, str) else node, path))
        return pd.DataFrame({
            "__doc": group["__doc"].tolist(), "leaf": own, "subroot": subroot, "root": whole,
            "proof_sha256": proof, "folded_root": folded, "verified": [f == whole for f in folded],
        })

    schema = "__doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _joined(leaves, above, height, proofs, schema)
    return found.select(F.col("__doc").cast(id_type).alias(id_col), *found.columns[1:])
