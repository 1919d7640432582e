"""Token inventories of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.tokens import line_tokens, token_kind


def tokens(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per token: keys of the line, position among its tokens, type and text."""
    keys = ["file_path", "line_no"] if keys is None else keys
    return lines.select(*keys, F.posexplode(line_tokens(F.col("text"))).alias("pos", "token")).withColumn(
        "type", token_kind(F.col("token"))
    )


def _counted(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(line_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def token_counts(lines: DataFrame) -> DataFrame:
    """How often each token occurs.  Its type follows from its text, so that it is told once per distinct token."""
    return _counted(lines).select(token_kind(F.col("token")).alias("type"), "token", "n")


def top_tokens(lines: DataFrame, kind: str, k: int) -> DataFrame:
    """The ``k`` most frequent tokens of a type.  ``host`` counts the hosts of addresses."""
    found = _counted(lines).where(token_kind(F.col("token")) == ("url" if kind == "host" else kind))
    if kind == "host":
        host = F.regexp_extract("token", r"^[^:/]+://(?:[^/?#@]*@)?([^/:?#]+)", 1)
        found = found.groupBy(host.alias("token")).agg(F.sum("n").alias("n")).where(F.col("token") != "")
    return found.orderBy(F.desc("n"), "token").limit(k)
