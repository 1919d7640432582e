"""Documents made of several log files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_logs(*logs: DataFrame) -> DataFrame:
    """One document out of several; a file that is in more than one of them counts in the first of them.

    Each log is read twice, once for its files only.  The file list is small (one row per file), so the
    semi-join runs as a broadcast unless Spark finds the list too large.
    """
    if len(logs) == 1:
        return logs[0]
    numbered = [log.withColumn("_log", F.lit(i)) for i, log in enumerate(logs)]
    files = reduce(DataFrame.union, [log.select("file_path", "_log") for log in numbered])
    owner = files.groupBy("file_path").agg(F.min("_log").alias("_log"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return every.join(owner, ["file_path", "_log"], "left_semi").select(*[f"`{c}`" for c in every.columns if c != "_log"])


def drop_file(lines: DataFrame, path: str) -> DataFrame:
    return lines.where(F.col("file_path") != path)


def source_count(lines: DataFrame) -> DataFrame:
    """Number of files in the document; rows show their file only if there are several."""
    files = lines.groupBy("file_path").agg(F.lit(1).alias("one"))
    return files.agg(F.count(F.lit(1)).alias("files")).withColumn("badge", F.col("files") > 1)
