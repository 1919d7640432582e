"""Reading and finding log files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.functions.detect import classify
from lumberline.operators.extract import extract_fields
from lumberline.operators.records import assign_records
from lumberline.plans.blocks import Schema
from lumberline.session import checkpoint_dir, removed, staged
from lumberline.sources.storage import Storage

EXTENSIONS = ("log", "txt")  # fixed values: files a directory scan looks at
#: Bytes of a unit, and the order marks that files begin with, longer ones first.
WIDE = {"UTF-16LE": 2, "UTF-16BE": 2, "UTF-32": 4, "UTF-32LE": 4, "UTF-32BE": 4}
MARKS = {
    b"\xff\xfe\x00\x00": "UTF-32LE",
    b"\x00\x00\xfe\xff": "UTF-32BE",
    b"\xef\xbb\xbf": "UTF-8",
    b"\xff\xfe": "UTF-16LE",
    b"\xfe\xff": "UTF-16BE",
}


def discover_logs(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below a folder with one of the extensions, in any case: path, size, modification time.

    Only the listing is read: the content column is pruned.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = [e.lower().lstrip(".") for e in extensions]
    return found.where(suffix.isin(wanted)).select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size"), "modificationTime"
    )


def _text(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    return spark.read.options(lineSep="\n", recursiveFileLookup="true", **options).text(paths)


BLOCK_LINES = 1 << 15  # lines of a block


def _keys() -> list:
    # Row of the scan's partition: the low bits of the generated id.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return [
        F.col("_metadata.file_path").alias("file_path"),
        # A split starts a block, and so does every so many lines: many small blocks spread evenly over
        # tasks.  A split has fewer blocks than bytes, so that the next one starts with a larger number.
        (F.col("_metadata.file_block_start") + F.floor(row / BLOCK_LINES)).alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("seq"),
    ]


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Physical lines of text files: ``(file_path, block, seq, text, raw_bytes, file_size)``.

    Lines end at ``\\n`` only, one ``\\r`` before it is dropped; a byte order mark is no text.  A
    large file is read by many tasks.  Encodings are UTF-8, those of ``WIDE``, and ``auto``: each file has that of its
    byte order mark, or UTF-8.  Another name is refused.  Of wide files sizes are in units of the encoding.
    """
    named = encoding.upper()
    if named == "AUTO":
        return _read_marked(spark, paths)
    if named in WIDE:
        return _read_wide(spark, paths, named)
    if named not in ("UTF-8", "UTF8"):
        raise ValueError(f"no reader for the encoding {encoding}")
    lines = _text(spark, paths).select(*_keys(), "value")
    return lines.select(
        "file_path", "block", "seq", "file_size",
        F.octet_length("value").cast("bigint").alias("raw_bytes"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
    )


def encodings(files: DataFrame) -> DataFrame:
    """``(file_path, encoding)`` of files by their byte order marks, null where there is none; four bytes of each are read."""
    storage = Storage.of(files.sparkSession)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["file_path"]:
                with storage.open(path) as handle:
                    begin = handle.read_at(4, 0)
                rows.append((path, next((name for mark, name in MARKS.items() if begin.startswith(mark)), None)))
            yield pd.DataFrame(rows, columns=["file_path", "encoding"], dtype=object)

    return files.select("file_path").mapInPandas(look, "file_path string, encoding string")


def _read_marked(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of several encodings, each group by its own reader."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("file_path"))
    # Names of files, as the driver lists them anyway.
    groups: dict[str, list[str]] = {}
    for row in staged(encodings(found), "encodings").toLocalIterator():
        groups.setdefault(row.encoding or "UTF-8", []).append(row.file_path)
    if set(groups) <= {"UTF-8"}:
        return read_lines(spark, paths)
    parts = [read_lines(spark, files, name) for name, files in sorted(groups.items())]
    columns = ["file_path", "block", "seq", "file_size", "raw_bytes", "text"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def _units(encoding: str) -> tuple[str, Column, Column]:
    """The name that Spark knows, a line end, and what must stand before bytes for their order to be known."""
    if encoding == "UTF-32LE":
        return "UTF-32", F.lit(b"\n\0\0\0"), F.lit(b"\xff\xfe\0\0")
    known = "UTF-32" if encoding == "UTF-32BE" else encoding
    return known, F.encode(F.lit("\n"), known), F.lit(b"")


def _read_wide(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """Lines of a file whose characters take several bytes.

    Spark cuts at the bytes of a newline, which can also stand across two characters.  A cut is real
    if it lies at a multiple of the character size; pieces between false cuts are joined again.
    Offsets are summed up in two steps, within blocks and along the blocks of a file.
    """
    unit = WIDE[encoding]
    known, newline, order = _units(encoding)
    pieces = _text(spark, paths, encoding=encoding).select(*_keys(), F.col("value").cast("binary").alias("piece"))
    pieces = staged(pieces, "pieces")  # read twice below
    size = F.octet_length("piece").cast("bigint")

    in_block = Window.partitionBy("file_path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    blocks = pieces.groupBy("file_path", "block").agg(F.sum(size).alias("bytes"))
    blocks = blocks.select("file_path", "block", F.coalesce(F.sum("bytes").over(along), zero).alias("bytes_before"))
    placed = pieces.withColumn("_in", F.coalesce(F.sum(size).over(in_block), zero)).join(blocks, ["file_path", "block"])
    starts = F.pmod(F.col("bytes_before") + F.col("_in"), F.lit(unit)) == 0
    placed = placed.withColumn("starts", starts)

    upto = Window.partitionBy("file_path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy("file_path", "block").agg(F.count_if("starts").alias("n"))
    counts = counts.select("file_path", "block", F.coalesce(F.sum("n").over(along), zero).alias("n_before"))
    line = F.col("n_before") + F.count(F.when(F.col("starts"), 1)).over(upto)
    whole = F.aggregate(
        F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))),
        F.lit(b""),
        lambda done, next: F.concat(done, F.when(F.length(done) > 0, newline).otherwise(F.lit(b"")), next["piece"]),
    )
    text = F.regexp_replace(F.decode(F.concat(order, F.col("bytes")), known), "^\ufeff", "")
    units = lambda size: F.floor(size / unit)
    return (
        placed.join(counts, ["file_path", "block"]).withColumn("line", line)
        .groupBy("file_path", "line").agg(F.min("block").alias("block"), F.max("file_size").alias("file_size"), whole.alias("bytes"))
        .select("file_path", "block", F.col("line").alias("seq"), units(F.col("file_size")).alias("file_size"),
                units(F.octet_length("bytes")).alias("raw_bytes"), F.regexp_replace(text, r"\r\z", "").alias("text"))
    )


def read_log(
    spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", schema: Schema | None = None, staging: str | None = None
) -> DataFrame:
    """Log files as classified lines in records, with fields if a schema is given.

    The classified lines are written to the checkpoint folder first.  Blocks depend on how a scan
    is split, which may change while executors come and go; the two steps that number the lines read
    the written blocks.  The text is read and matched once; what the blocks carry over needs a few narrow
    columns.  ``staging`` names the folder they are written to, which the result reads.
    """
    lines, matched = read_lines(spark, paths, encoding), None
    if schema is not None:
        lines, matched = extract_fields(lines, schema), F.col("fields").isNotNull()
    staging = staging or f"{checkpoint_dir(spark).rstrip('/')}/classified-{uuid.uuid4().hex}"
    classify(lines, matched).write.parquet(staging)
    classified = spark.read.parquet(staging)
    return assign_records(classified, fields="fields" if schema is not None else None)


def ingest_log(
    spark: SparkSession, paths: str | list[str], table: str, encoding: str = "UTF-8", schema: Schema | None = None,
    by_date: bool = True,
) -> DataFrame:
    """Read log files into a table of lines, once, and return the table.  What was staged for it goes again."""
    staging = f"{checkpoint_dir(spark).rstrip('/')}/classified-{uuid.uuid4().hex}"
    stored = store_lines(read_log(spark, paths, encoding, schema, staging), table, by_date)
    removed(spark, staging)
    return stored


def store_lines(lines: DataFrame, path: str, by_date: bool = True) -> DataFrame:
    """Write the lines of a document as a table and return it.

    Queries on the table read only the columns they use, and with ``by_date`` only the days they ask
    for.  Lines without time have a partition of their own.
    """
    day = F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int"))
    if by_date:
        # A range of days, files and blocks per task: few files per day, however many tasks read the lines.
        ranges = [c for c in ("log_date", "file_path", "block") if c == "log_date" or c in lines.columns]
        lines.withColumn("log_date", day).repartitionByRange(*ranges).write.partitionBy("log_date").parquet(path)
    else:
        lines.write.parquet(path)
    return lines.sparkSession.read.parquet(path)
