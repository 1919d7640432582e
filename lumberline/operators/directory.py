"""Statistics per file of a directory, and filters over them.

Unlike document statistics these look at each line by itself: its own level, and times in the
order of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.detect import ERROR, FATAL, WARN
from lumberline.functions.rules import contains_literal, java_regex, regex_is_valid
from lumberline.operators.filters import Moment, to_ms


def scan_directory(classified: DataFrame) -> DataFrame:
    """Lines, first and last time, warnings, errors and fatals per file, from its classified lines.

    Blocks are counted first and files from their blocks, so that a huge file is many small sums;
    all buffers have a fixed width.
    """
    at = F.when(F.col("own_ms").isNotNull(), F.col("seq"))
    level = F.col("own_level")
    size = [F.max("file_size").alias("size")] if "file_size" in classified.columns else []
    blocks = classified.groupBy("file_path", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min_by("own_ms", at).alias("first_ms"), F.max_by("own_ms", at).alias("last_ms"),
        F.count_if(level == WARN).alias("warn"), F.count_if(level == ERROR).alias("error"),
        F.count_if(level == FATAL).alias("fatal"), *size,
    )
    dated = F.when(F.col("first_ms").isNotNull(), F.col("block"))
    return blocks.groupBy("file_path").agg(
        *[F.max("size").alias("size") for _ in size],
        F.sum("lines").alias("lines"),
        F.min_by("first_ms", dated).alias("first_ms"), F.max_by("last_ms", dated).alias("last_ms"),
        F.sum("warn").alias("warn"), F.sum("error").alias("error"), F.sum("fatal").alias("fatal"),
    )


def date_bounds(files: DataFrame) -> DataFrame:
    return files.agg(F.min("first_ms").alias("from_ms"), F.max("last_ms").alias("to_ms"))


def alert_key() -> Column:
    """Sorts by fatals, then errors, then warnings."""
    return F.col("fatal") * 10**12 + F.col("error") * 10**6 + F.col("warn")


def sort_files(files: DataFrame, column: str = "alerts", descending: bool = True) -> DataFrame:
    """Order the table of files by a column: numbers by value, texts without regard to case."""
    if column == "alerts":
        key = alert_key()
    elif files.schema[column].dataType.typeName() == "string":
        key = F.lower(F.col(column))
    else:
        key = F.col(column)
    return files.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "file_path")


def content_condition(text: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Whether a line contains the text; an unreadable expression is in no line."""
    if not regex:
        return contains_literal(F.col("text"), text, case_sensitive)
    pattern = java_regex(text, case_sensitive)
    return F.col("text").rlike(pattern) if regex_is_valid(pattern) else F.lit(False)


def filter_files_by_content(
    files: DataFrame, lines: DataFrame, text: str, regex: bool = False, case_sensitive: bool = False
) -> DataFrame:
    """Keep the files with a matching line.

    Matches are reduced to their distinct files map-side before the semi-join, so that a file full
    of matches costs one row per task.
    """
    hits = lines.where(content_condition(text, regex, case_sensitive)).select("file_path").distinct()
    return files.join(hits, "file_path", "left_semi")


def content_match_summary(files: DataFrame, matching: DataFrame) -> DataFrame:
    """``n`` of ``m`` files matched."""
    m = files.agg(F.count(F.lit(1)).alias("m"))
    return matching.agg(F.count(F.lit(1)).alias("matched")).withColumn("files", m.scalar())


def date_overlap(start: Moment, end: Moment) -> Column:
    """Whether the time range of a file meets the window; files without times do."""
    lo, hi = to_ms(start), to_ms(end)
    first, last = F.coalesce("first_ms", "last_ms"), F.coalesce("last_ms", "first_ms")
    meets = F.lit(True)
    if lo is not None:
        meets = meets & (last >= lo)
    if hi is not None:
        meets = meets & (first <= hi)
    return F.coalesce(meets, F.lit(True))


def filter_files_by_date(files: DataFrame, start: Moment = None, end: Moment = None) -> DataFrame:
    return files.where(date_overlap(start, end))


def directory_tree(files: DataFrame, visible: Column) -> DataFrame:
    """Files and folders with whether they show: a folder shows if anything below it does."""
    parts = F.split("file_path", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    paths = F.filter(F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != "")
    return (
        files.withColumn("_visible", visible)
        .select("file_path", "_visible", F.explode(paths).alias("path"))
        .groupBy("path")
        .agg(
            F.bool_or("_visible").alias("visible"),
            F.count_if(F.col("_visible")).alias("visible_files"), F.count(F.lit(1)).alias("files"),
            F.bool_or(F.col("path") == F.col("file_path")).alias("is_file"),
        )
    )
