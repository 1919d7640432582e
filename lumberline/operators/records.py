"""Line numbers, logical records and everything that groups lines into records.

A file may be one third of all data, so no step hands a whole file to one task.  Lines are
partitioned by (file, block); what a block must know of the blocks before it is one row per
block, aggregated map-side and summed up along the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.detect import ms_to_ntz

RECORD_LINES = 2000        # fixed value: lines shown of one record
RECORD_CHARS = 256 * 1024  # fixed value: characters shown of one record

KEYS = ["file_path", "block"]


def _before(blocks: Window) -> Window:
    return blocks.rowsBetween(Window.unboundedPreceding, -1)


def block_totals(lines: DataFrame, with_records: bool) -> DataFrame:
    """One row per block.  Only fixed-width buffers, so the aggregate hashes and combines map-side."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if with_records:
        at = F.when(F.col("is_primary"), F.col("seq"))
        aggs += [
            F.count_if("is_primary").alias("p"),
            F.max_by("own_ms", at).alias("last_ms"),
            F.max_by("own_level", at).alias("last_level"),
            F.min_by("is_primary", "seq").alias("opens"),
        ]
    if "file_size" in lines.columns:
        aggs += [F.sum(F.col("raw_bytes") + 1).alias("bytes"), F.max("file_size").alias("size")]
    return lines.groupBy(*KEYS).agg(*aggs)


def block_carry(totals: DataFrame) -> DataFrame:
    """What each block inherits from the blocks before it in its file."""
    blocks = Window.partitionBy("file_path").orderBy("block")
    before = _before(blocks)
    cols = [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before")]
    if "p" in totals.columns:
        last = F.when(F.col("p") > 0, F.struct("last_ms", "last_level"))
        cols += [
            F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p_before"),
            F.last(last, ignorenulls=True).over(before).alias("head_before"),
            F.first("opens").over(blocks).alias("opens_file"),
        ]
    if "size" in totals.columns:
        whole = Window.partitionBy("file_path")
        # Every line counts one byte for its newline; a byte order mark takes three that are in no line.
        excess = F.sum("bytes").over(whole) - F.max("size").over(whole)
        cols += [
            F.sum("n").over(whole).alias("n_file"),
            excess.isin(1, -2).alias("unterminated"),
        ]
    return totals.select(*KEYS, *cols)


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, counted from 1 within each file.

    Like ``assign_records`` this reads the lines twice; lines straight from a file scan should be
    written first (``session.staged``), so that both times have the same blocks.
    """
    in_block = Window.partitionBy(*KEYS).orderBy("seq")
    numbered = lines.withColumn("_row", F.row_number().over(in_block))
    carry = block_carry(block_totals(lines.select(*KEYS, "seq"), with_records=False))
    return (
        numbered.join(carry, KEYS)
        .withColumn("line_no", (F.col("n_before") + F.col("_row")).cast("bigint"))
        .drop("_row", "n_before")
    )


def plain_flag(fields: Column | None = None) -> Column:
    """No time, no level and no field: free text rather than a log line."""
    plain = F.col("ts_ms").isNull() & (F.col("level") == 0)
    return plain if fields is None else plain & fields.isNull()


START = ["start_line", "start_id", "start_ms", "start_level"]


def last_context(lines: DataFrame) -> DataFrame:
    """What the next line of each file continues: last line and record number, time and level."""
    return lines.groupBy("file_path").agg(
        F.max("line_no").alias("start_line"), F.max("logical_id").alias("start_id"),
        F.max_by("ts_ms", "line_no").alias("start_ms"), F.max_by("level", "line_no").alias("start_level"),
    )


def assign_records(classified: DataFrame, fields: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """Number the lines, number the records, and give every line its record's time and level.

    A record is a primary line and the lines up to the next one.  Lines before the first primary
    line are record 0, without time and level; the first primary line is then record 1.

    ``start`` continues files that are known already: one row per file as from ``last_context``.
    """
    upto = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("is_primary"), F.struct("own_ms", "own_level"))
    local = classified.withColumns(
        {
            "_row": F.count(F.lit(1)).over(upto),
            "_prim": F.count(F.when(F.col("is_primary"), 1)).over(upto),
            "_head": F.last(head, ignorenulls=True).over(upto),
        }
    )
    carry = block_carry(block_totals(classified, with_records=True))
    # Number of the record before the first primary line: none at all if the file opens with one.
    opening = F.when(F.col("opens_file"), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    if start is None:
        carry = carry.withColumns(
            {"start_line": F.lit(0), "start_id": opening, "start_ms": F.lit(None).cast("bigint"), "start_level": F.lit(0)}
        )
    else:
        carry = carry.join(start.select("file_path", *START), "file_path", "left").withColumns(
            {"start_line": F.coalesce("start_line", F.lit(0)), "start_id": F.coalesce("start_id", opening)}
        )
    carry = carry.withColumn(
        "head_before",
        F.coalesce("head_before", F.struct(F.col("start_ms").alias("last_ms"), F.col("start_level").alias("last_level"))),
    )
    here, inherited = F.col("_prim") > 0, F.col("head_before")
    out = (
        local.join(carry, KEYS)
        .withColumn("line_no", (F.col("start_line") + F.col("n_before") + F.col("_row")).cast("bigint"))
        .withColumn("logical_id", (F.col("start_id") + F.col("p_before") + F.col("_prim")).cast("bigint"))
        .withColumn("ts_ms", F.when(here, F.col("_head.own_ms")).otherwise(inherited["last_ms"]))
        .withColumn(
            "level",
            F.coalesce(F.when(here, F.col("_head.own_level")).otherwise(inherited["last_level"]), F.lit(0)),
        )
        .withColumn("ts", ms_to_ntz(F.col("ts_ms")))
    )
    shown = F.when(F.col("is_primary"), F.col(fields)) if fields else None
    if fields:
        out = out.withColumn(fields, shown)
    out = out.withColumn("is_plain", plain_flag(F.col(fields) if fields else None))
    if "unterminated" in carry.columns:
        last = F.col("n_before") + F.col("_row") == F.col("n_file")
        out = out.withColumn("provisional", F.col("unterminated") & last)
        out = out.drop("unterminated", "n_file", "file_size", "raw_bytes")
    return out.drop("_row", "_prim", "_head", "n_before", "p_before", "head_before", "opens_file", *START)


def record_key() -> list[Column]:
    """Lines of free text are records of their own; other lines share their record's number."""
    return [
        F.col("file_path"),
        F.col("logical_id"),
        F.when(F.col("is_plain"), F.col("line_no")).otherwise(F.lit(0)).cast("bigint").alias("plain_line"),
    ]


def record_heads(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """The first line of every record.

    In a whole document these are the primary and the free-text lines, so a filter is enough.  In
    a filtered view a record may have lost its first line; the first one left is found by a grouping.
    """
    if not filtered:
        return lines.where(F.col("is_primary") | F.col("is_plain"))
    rows = F.struct(*[F.col(c) for c in lines.columns])
    return (
        lines.groupBy(*record_key()).agg(F.min_by(rows, F.col("line_no")).alias("_first")).select("_first.*")
    )


def record_carry(parts: DataFrame) -> DataFrame:
    """What the blocks before hold of the record that a block begins with; one row per block that goes on with one.

    ``parts`` has a row per block and record: ``first_line, n_lines, n_chars``.  The windows run over one row
    per block, never over the lines or parts of a record.
    """
    blocks = parts.groupBy(*KEYS).agg(
        F.min("logical_id").alias("first_id"), F.max("logical_id").alias("last_id"),
        *[F.max_by(c, "logical_id").alias(f"last_{c}") for c in ("first_line", "n_lines", "n_chars")],
    )
    along = Window.partitionBy("file_path").orderBy("block")
    before = _before(along)
    goes_on = F.coalesce(F.lag("last_id").over(along) == F.col("first_id"), F.lit(False))
    summed = blocks.withColumns({
        "_on": goes_on,
        "_lines": F.coalesce(F.sum("last_n_lines").over(before), F.lit(0)),
        # Parts of a record are joined by a line end each.
        "_chars": F.coalesce(F.sum(F.col("last_n_chars") + 1).over(before), F.lit(0)),
    })
    begins = F.when(~F.col("_on") | (F.col("first_id") < F.col("last_id")), F.struct("last_first_line", "_lines", "_chars"))
    start = F.last(begins, ignorenulls=True).over(before)
    return summed.withColumn("_start", start).where("_on").select(
        *KEYS, "first_id", F.col("_start.last_first_line").alias("start_line"),
        (F.col("_lines") - F.col("_start._lines")).alias("lines_before"),
        (F.col("_chars") - F.col("_start._chars")).alias("chars_before"),
    )


def _record_parts(lines: DataFrame) -> DataFrame:
    """What each block has of each record, free text aside, and where in the record it stands.

    ``parts`` says that the record is in more than one block.  Only these need a further grouping.
    """
    line = F.struct("line_no", "text")
    texts = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"])
    parts = lines.where(~F.col("is_plain")).groupBy(*KEYS, "logical_id").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"),
        F.max("ts_ms").alias("ts_ms"), F.max("level").alias("level"), texts.alias("texts"),
    )
    narrow = lines.where(~F.col("is_plain")).select(*KEYS, "logical_id", "line_no", F.length("text").alias("_n")).groupBy(*KEYS, "logical_id").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), (F.sum("_n") + F.count(F.lit(1)) - 1).alias("n_chars"))
    carry = record_carry(narrow).withColumnRenamed("first_id", "logical_id")
    # The last record of a block goes on if the next block has something before it.
    along = Window.partitionBy("file_path").orderBy("block")
    ids = narrow.groupBy(*KEYS).agg(F.min("logical_id").alias("_first"), F.max("logical_id").alias("logical_id"))
    goes_on = ids.withColumn("_next", F.lead("_first").over(along)).where(F.col("_next") == F.col("logical_id")).select(*KEYS, "logical_id", F.lit(True).alias("_goes_on"))
    return (
        parts.join(carry, [*KEYS, "logical_id"], "left").join(goes_on, [*KEYS, "logical_id"], "left")
        .withColumns({
            "parts": F.col("start_line").isNotNull() | F.coalesce("_goes_on", F.lit(False)),
            "record_line": F.coalesce("start_line", "first_line"),
            "lines_before": F.coalesce("lines_before", F.lit(0)), "chars_before": F.coalesce("chars_before", F.lit(0)),
        })
        .drop("start_line", "_goes_on")
    )


def _free_text(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("is_plain")).select(
        "file_path", "logical_id", F.col("line_no").alias("first_line"), F.lit(1).cast("bigint").alias("n_lines"), "ts_ms", "level", "text",
    )


def record_chunks(lines: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """The whole text of each record as rows ``(file_path, logical_id, first_line, chunk_no, n_lines, ts_ms, level, text)``.

    Chunks of ``chunk_chars`` characters, the last one shorter, make up the record's lines joined by newlines;
    nothing is left out, however long a record is.  ``n_lines`` counts the lines that begin in the chunk.  A
    task has a block of lines or one chunk, so that an endless record is many tasks.
    """
    parts = _record_parts(lines)
    joined = F.array_join("texts", "\n")
    # What begins inside a record begins with the line end before it.
    text = F.when(F.col("chars_before") > 0, F.concat(F.lit("\n"), joined)).otherwise(joined)
    begin = F.greatest(F.col("chars_before") - 1, F.lit(0))
    size = F.lit(chunk_chars)
    placed = parts.withColumns({"_text": text, "_begin": begin}).withColumn("_end", F.col("_begin") + F.length("_text"))
    numbers = F.sequence(F.floor(F.col("_begin") / size), F.floor(F.greatest(F.col("_end") - 1, F.col("_begin")) / size))
    cut = placed.withColumn("chunk_no", F.explode(numbers))
    low, high = F.greatest(F.col("chunk_no") * size, F.col("_begin")), F.least((F.col("chunk_no") + 1) * size, F.col("_end"))
    piece = F.substring(F.col("_text"), (low - F.col("_begin") + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.withColumns({"text": piece, "_at": low})
    opened = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + F.when((F.col("_at") == 0) & (F.col("chars_before") == 0), 1).otherwise(0)
    pieces = pieces.withColumn("n_lines", opened.cast("bigint"))
    columns = ["file_path", "logical_id", "first_line", "chunk_no", "n_lines", "ts_ms", "level", "text"]
    whole = pieces.where(~F.col("parts"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])
    met = pieces.where("parts").groupBy("file_path", "logical_id", F.col("record_line").alias("first_line"), "chunk_no").agg(
        F.sum("n_lines").alias("n_lines"), F.max("ts_ms").alias("ts_ms"), F.max("level").alias("level"), F.array_join(ordered, "").alias("text"))
    free = _free_text(lines).withColumn("_text", F.col("text")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.length("_text") - 1, F.lit(0)) / size))))
    free = free.withColumns({
        "text": F.substring(F.col("_text"), (F.col("chunk_no") * size + 1).cast("int"), size), "n_lines": (F.col("chunk_no") == 0).cast("bigint"),
    })
    return whole.select(*columns).unionByName(met.select(*columns)).unionByName(free.select(*columns))


def assemble_records(lines: DataFrame, max_lines: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One row per record with its text: its lines joined by newlines, whole unless a limit is given.

    ``RECORD_LINES`` and ``RECORD_CHARS`` are the limits of a shown head; ``truncated`` says that a record goes
    on beyond them, ``n_lines`` counts all its lines.  Records inside a block are put together there; of those
    that go over blocks, a task gets one row per block with no more than the limits allow.  Without
    limits such a row is as long as its record: ``record_chunks`` has no such rows.
    """
    parts = _record_parts(lines)
    kept = F.col("texts")
    if max_lines is not None:
        kept = F.slice(kept, F.lit(1), F.greatest(F.lit(max_lines) - F.col("lines_before"), F.lit(0)).cast("int"))
    parts = parts.withColumn("_kept", kept).withColumns({"_text": F.array_join("_kept", "\n"), "_n": F.size("_kept").cast("bigint")})
    parts = parts.withColumn("_chars", F.length("_text").cast("bigint"))
    if max_chars is not None:  # what begins behind the limit is counted and not sent
        parts = parts.withColumn("_text", F.when(F.col("chars_before") <= max_chars, F.left(F.col("_text"), F.lit(max_chars))))
    inside = parts.where(~F.col("parts")).select(
        "file_path", "logical_id", "first_line", "n_lines", "ts_ms", "level", F.col("_text").alias("text"), "_n", "_chars")
    shown = F.when((F.col("_n") > 0) & F.col("_text").isNotNull(), F.struct("lines_before", "_text"))
    over = parts.where("parts").groupBy("file_path", "logical_id", F.col("record_line").alias("first_line")).agg(
        F.sum("n_lines").alias("n_lines"), F.max("ts_ms").alias("ts_ms"), F.max("level").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["_text"]), "\n").alias("text"),
        F.sum("_n").alias("_n"), (F.sum(F.when(F.col("_n") > 0, F.col("_chars") + 1)) - 1).alias("_chars"),
    )
    free = _free_text(lines).withColumns({"_n": F.col("n_lines"), "_chars": F.length("text").cast("bigint")})
    both = inside.unionByName(over).unionByName(free)
    more = F.col("n_lines") > F.col("_n")
    if max_chars is not None:
        more = more | (F.col("_chars") > max_chars)
        both = both.withColumn("text", F.left(F.col("text"), F.lit(max_chars)))
    return both.withColumn("truncated", more).drop("_n", "_chars")


def record_headers(lines: DataFrame) -> DataFrame:
    """Level, time, first and last line and number of lines of each record; free text has no entry number."""
    return (
        lines.groupBy(*record_key())
        .agg(
            F.max("level").alias("level"), F.max("ts_ms").alias("ts_ms"),
            F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
            F.count(F.lit(1)).alias("n_lines"), F.first("is_plain").alias("is_plain"),
        )
        .withColumn("entry_no", F.when(~F.col("is_plain"), F.col("logical_id")))
        .drop("plain_line", "logical_id")
    )


def record_fields(lines: DataFrame, fields: str = "fields") -> DataFrame:
    """Fields of each record: those of its first line that has any."""
    return (
        lines.where(~F.col("is_plain") & F.col(fields).isNotNull())
        .groupBy("file_path", "logical_id")
        .agg(F.min_by(F.col(fields), F.col("line_no")).alias(fields))
    )


def mark_new(lines: DataFrame, batch: str = "ingest_batch") -> DataFrame:
    """Flag the rows that came with the latest append."""
    latest = lines.agg(F.max(batch).alias("latest"))
    return lines.withColumn("is_new", F.col(batch) == latest.scalar())
