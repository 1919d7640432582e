"""What changed in a set of log files since it was last read, and reading only that.

A manifest has one row per file: ``file_path``, ``size``, ``consumed`` (bytes up to the end of the
last complete line) and ``fingerprint`` (hash of the bytes just before ``consumed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.detect import classify
from lumberline.operators.records import assign_records, last_context
from lumberline.session import pinned, staged
from lumberline.sources.files import read_log
from lumberline.sources.storage import Storage, range_lines

BOUNDARY_BYTES = 4096      # fixed value: bytes before the old end that must not have changed
RANGE_BYTES = 64 << 20     # bytes of a new tail that one task reads
STEP_BYTES = 64 << 10


def _line_end(handle, size: int) -> int:
    """Offset behind the last newline before ``size``."""
    at = size
    while at > 0:
        start = max(0, at - STEP_BYTES)
        found = handle.read_at(at - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def _with_fingerprints(files: DataFrame) -> DataFrame:
    """One row per file, written down: the files may change before it is read again.

    Of each file the bytes before ``at`` are hashed, or those before its last line end if ``at`` is null.
    """
    storage = Storage.of(files.sparkSession)

    def boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, at in zip(batch["file_path"], batch["size"], batch["at"]):
                # A file that cannot be read fails the task: taken for a new one it would be loaded twice.
                with storage.open(path) as handle:
                    end = _line_end(handle, int(size)) if pd.isna(at) else int(at)
                    start = max(0, end - BOUNDARY_BYTES)
                    boundary = handle.read_at(end - start, start) if end <= size else None
                rows.append((path, size, end, boundary))
            yield pd.DataFrame(rows, columns=["file_path", "size", "consumed", "boundary"], dtype=object)

    read = files.mapInPandas(boundaries, "file_path string, size bigint, consumed bigint, boundary binary")
    return pinned(read.select("file_path", "size", "consumed", F.xxhash64("boundary").alias("fingerprint")))


def capture_manifest(files: DataFrame) -> DataFrame:
    """Manifest of files ``(file_path, file_size)``; a few kilobytes of each are read."""
    return _with_fingerprints(
        files.select("file_path", F.col("file_size").cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("at"))
    )


def current_state(files: DataFrame, previous: DataFrame) -> DataFrame:
    """The files as they are now, with the fingerprint at the offset consumed before."""
    sized = files.select("file_path", F.col("file_size").cast("bigint").alias("size"))
    known = sized.join(previous.select("file_path", F.col("consumed").alias("at")), "file_path", "left")
    at_old_end = known.where(F.col("at").isNotNull())
    fresh = known.where(F.col("at").isNull()).select(
        "file_path", "size", F.lit(None).cast("bigint").alias("fingerprint")
    )
    return _with_fingerprints(at_old_end).drop("consumed").unionByName(fresh)


def change_kind() -> Column:
    """Of a joined row: how the file changed.  Only a file that kept its old bytes was appended to."""
    return (
        F.when(F.col("consumed").isNull(), "new")
        .when(F.col("size").isNull(), "missing")
        .when(F.col("size") < F.col("consumed"), "replaced")
        .when(~F.col("fingerprint").eqNullSafe(F.col("now")), "replaced")
        # An open last line lies behind what was consumed; it is no news until the file grows.
        .when((F.col("size") > F.col("consumed")) & ~F.col("size").eqNullSafe(F.col("old_size")), "appended")
        .otherwise("unchanged")
    )


def diff_manifest(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Each file of either state with its change: unchanged, appended, replaced, missing, new."""
    size = F.col("size") if "size" in previous.columns else F.lit(None).cast("bigint")
    old = previous.select("file_path", "consumed", "fingerprint", size.alias("old_size"))
    new = current.select("file_path", "size", F.col("fingerprint").alias("now"))
    return old.join(new, "file_path", "full_outer").select("file_path", "consumed", "size", change_kind().alias("change"))


def read_ranges(changes: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of files ``(file_path, first, size)`` from byte ``first`` to ``size``; other bytes are not read.

    A long tail is cut into ranges, each a block read by its own task.
    """
    starts = F.sequence(F.col("first"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = (
        changes.where(F.col("size") > F.col("first"))
        .select("file_path", "first", "size", F.explode(starts).alias("start"))
        .withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))
    )
    storage = Storage.of(changes.sparkSession)
    names = ["file_path", "block", "seq", "text", "provisional"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, size, start, stop in zip(*(batch[c] for c in ("file_path", "first", "size", "start", "stop"))):
                rows: list[tuple] = []
                with storage.open(path) as handle:
                    for at, line, ended in range_lines(handle, int(first), int(start), int(stop), int(size)):
                        rows.append((path, int(start), at, line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line, not ended))
                        if len(rows) == 8192:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    lines = ranges.repartition("file_path", "start").mapInPandas(read, "file_path string, block bigint, seq bigint, text binary, provisional boolean")
    return lines.withColumn("text", F.col("text").cast("string"))  # the same bytes, as in Spark's reader


def read_changes(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Classified lines of new, replaced and appended files; appended ones continue their records.

    New and replaced files are read by Spark, like any other; of appended files the new bytes alone are
    read.  The names of the former are listed on the driver, as those of all files are when a folder is read.
    """
    spark = lines.sparkSession
    tails = changes.where(F.col("change") == "appended").select("file_path", "size", F.col("consumed").alias("first"))
    known = lines.where(~F.coalesce(F.col("provisional"), F.lit(False))).join(tails.select("file_path"), "file_path", "left_semi")
    fresh = staged(classify(read_ranges(tails)), "changes")  # read from files that may go on growing
    grown = assign_records(fresh, start=last_context(known))
    whole = [row.file_path for row in changes.where(F.col("change").isin("new", "replaced")).select("file_path").toLocalIterator()]
    return grown.unionByName(read_log(spark, whole), allowMissingColumns=True) if whole else grown


def refresh(lines: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The document after its files changed: old rows of replaced and missing files go, fresh rows come.

    The unfinished last line of an appended file was read again with its end, so it goes as well.
    Rows that the document already has of a new file go too, so that no file is in it twice.
    """
    gone = changes.where(F.col("change").isin("new", "replaced", "missing")).select("file_path")
    grown = changes.where(F.col("change") == "appended").select("file_path", F.lit(True).alias("grown"))
    kept = lines.join(gone, "file_path", "left_anti").join(grown, "file_path", "left")
    unfinished = F.coalesce(F.col("grown") & F.col("provisional"), F.lit(False))
    return kept.where(~unfinished).drop("grown").unionByName(fresh, allowMissingColumns=True)
