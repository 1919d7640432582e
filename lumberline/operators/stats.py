"""Statistics of a document: totals, levels, rates, templates, files, histograms.

Records are counted, not lines; every line of free text counts as a record.  ``filtered`` says
that the lines are a filtered view, in which records may have lost their first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.detect import ERROR, FATAL, WARN, level_name
from lumberline.functions.text import normalize
from lumberline.operators.order import position
from lumberline.operators.records import record_heads, record_key
from lumberline.session import pinned

BINS = 720            # fixed value: bins of the statistics histogram
TIMELINE_BINS = 4096  # fixed value: bins of the timeline
TOP_MESSAGES, TOP_ERRORS = 10, 5  # fixed values: lengths of the top lists


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def counted_lines(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Rows ``(file_path, ts_ms, level, is_head, n_lines)`` from which records and lines are counted.

    A whole document needs no grouping: each line says by itself whether it opens a record.
    """
    if not filtered:
        head = F.col("is_primary") | F.col("is_plain")
        return lines.select("file_path", "ts_ms", "level", head.alias("is_head"), F.lit(1).alias("n_lines"))
    # All lines of a record share its time and level.
    return (
        lines.groupBy(*record_key())
        .agg(F.max("ts_ms").alias("ts_ms"), F.max("level").alias("level"), F.count(F.lit(1)).alias("n_lines"))
        .select("file_path", "ts_ms", "level", F.lit(True).alias("is_head"), "n_lines")
    )


def counted_records(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """One row ``(file_path, ts_ms, level)`` per record."""
    return counted_lines(lines, filtered).where("is_head").drop("is_head", "n_lines")


def totals(lines: DataFrame, filtered: bool = False) -> DataFrame:
    head = F.col("is_head")
    return counted_lines(lines, filtered).agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("lines"),
        _count_if(head, "records"),
        _count_if(head & F.col("ts_ms").isNotNull(), "records_with_ts"),
    )


def level_counts(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Records per level and their share in percent."""
    counts = counted_records(lines, filtered).groupBy("level").agg(F.count(F.lit(1)).alias("records"))
    whole = F.sum("records").over(Window.partitionBy())  # at most seven rows
    return counts.select(
        "level", level_name(F.col("level")).alias("level_name"), "records",
        (F.col("records") * 100.0 / whole).alias("share"),
    )


def _span_aggs() -> list[Column]:
    return [F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"), F.count("ts_ms").alias("records_with_ts")]


def rates(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Time span and records per second over it."""
    span = F.col("to_ms") - F.col("from_ms")
    return (
        counted_records(lines, filtered).agg(*_span_aggs())
        .withColumn("span_ms", span)
        .withColumn("avg_per_sec", F.when(span > 0, F.col("records_with_ts") * 1000.0 / span).otherwise(0.0))
    )


def bins720(lines: DataFrame, filtered: bool = False, bins: int = BINS) -> DataFrame:
    """Records and errors per bin of equal length, empty bins included.

    Every row also carries ``from_ms``, ``width_ms`` and the number of records with a time, so that
    what is built on the bins needs no further pass.  No rows if the span is empty.
    """
    dated = counted_records(lines, filtered).where(F.col("ts_ms").isNotNull())
    span = dated.agg(*_span_aggs())
    whole = span.select(F.struct("*")).scalar()  # one subquery, however often it is used
    lo, hi, n = whole["from_ms"], whole["to_ms"], whole["records_with_ts"]
    width = (hi - lo) / F.lit(float(bins))
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col("ts_ms") - lo) / width)).cast("int")
    errors = F.col("level").isin(ERROR, FATAL)
    counts = (
        dated.where(hi > lo).groupBy(bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), _count_if(errors, "errors"))
    )
    every = lines.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counts, "bin", "left").na.fill(0, ["n", "errors"])
        .select("bin", "n", "errors", lo.alias("from_ms"), width.alias("width_ms"), n.alias("records_with_ts"))
        .where("width_ms > 0")
    )


def bin_start(bin_no: Column) -> Column:
    return F.col("from_ms") + (bin_no * F.col("width_ms")).cast("bigint")


def peak_rate(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """The busiest bin, the earliest one if there are several, and its records per second."""
    top = bins720(lines, filtered).orderBy(F.desc("n"), "bin").limit(1)
    return top.select(
        "bin", (F.col("n") * 1000.0 / F.col("width_ms")).alias("peak_per_sec"),
        bin_start(F.col("bin")).alias("peak_from_ms"), bin_start(F.col("bin") + 1).alias("peak_to_ms"),
    )


# ---- templates ---------------------------------------------------------------------------------


def _template_rows(lines: DataFrame, filtered: bool) -> DataFrame:
    return record_heads(lines, filtered).withColumn("template", normalize(F.col("text")))


def template_counts(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Records per template with their time range.  Fixed-width buffers only: a pure hash aggregate."""
    return (
        _template_rows(lines, filtered).groupBy("template")
        .agg(F.count(F.lit(1)).alias("records"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    )


def templates(lines: DataFrame, filtered: bool = False, only: DataFrame | None = None) -> DataFrame:
    """All message templates: count, time range, and level, text and place of the first message.

    ``only`` is a bounded table ``(template, at)``: just the messages of these templates at these times.
    """
    rows = _template_rows(lines, filtered)
    if only is not None:
        wanted = only.withColumnRenamed("template", "_wanted")
        rows = rows.join(F.broadcast(wanted), (F.col("template") == F.col("_wanted")) & F.col("ts_ms").eqNullSafe(F.col("at")), "left_semi")
    first = F.struct("level", F.col("text").alias("example"), "file_path", "logical_id")
    return (
        rows.groupBy("template")
        .agg(
            F.count(F.lit(1)).alias("records"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
            F.min_by(first, position()).alias("first"),
        )
        .select(
            "template", "records", "first_ms", "last_ms", F.col("first.level").alias("level"),
            F.col("first.example").alias("example"), F.col("first.file_path").alias("first_file"),
            F.col("first.logical_id").alias("first_entry"),
        )
    )


def top_k(counts: DataFrame, k: int, by: str = "records", then: str = "template") -> DataFrame:
    return counts.orderBy(F.desc(by), then).limit(k)


def _with_share(found: DataFrame, lines: DataFrame, filtered: bool) -> DataFrame:
    records = totals(lines, filtered).select("records").scalar()
    return found.withColumn("share", F.col("records") / records)


def top_messages(lines: DataFrame, k: int = TOP_MESSAGES, filtered: bool = False) -> DataFrame:
    """The most frequent templates with the details of their first message.

    The ranking needs counts only.  The first message of a winner has the winner's first time, so
    that the second pass reads texts for those few moments alone.
    """
    winners = pinned(top_k(template_counts(lines, filtered), k))  # at most ``k`` rows, read twice
    heads = winners.select("template", F.col("first_ms").alias("at"))
    # One row per winner.
    details = templates(lines, filtered, heads).select("template", "level", "example", "first_file", "first_entry")
    found = winners.join(F.broadcast(details), "template")
    return top_k(_with_share(found, lines, filtered), k)


def top_errors(lines: DataFrame, k: int = TOP_ERRORS, filtered: bool = False) -> DataFrame:
    """The most frequent templates whose first message is an error or fatal."""
    errors = templates(lines, filtered).where(F.col("level").isin(ERROR, FATAL))
    return _with_share(top_k(errors, k), lines, filtered)


# ---- files -------------------------------------------------------------------------------------


def file_breakdown(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Records, lines, warnings, errors and time range per file; most lines first."""
    head, level = F.col("is_head"), F.col("level")
    time = F.when(head, F.col("ts_ms"))
    return (
        counted_lines(lines, filtered).groupBy("file_path")
        .agg(
            _count_if(head, "records"), F.sum("n_lines").cast("bigint").alias("lines"),
            _count_if(head & (level == WARN), "warn"), _count_if(head & (level == ERROR), "error"),
            _count_if(head & (level == FATAL), "fatal"),
            F.min(time).alias("first_ms"), F.max(time).alias("last_ms"),
        )
        .orderBy(F.desc("lines"), "file_path")
    )


# ---- timeline ----------------------------------------------------------------------------------


def timeline(
    lines: DataFrame, bins: int = TIMELINE_BINS, from_ms: int | None = None, to_ms: int | None = None,
    filtered: bool = False,
) -> DataFrame:
    """Records, warnings, errors and fatals per bin; only bins with records.

    The range is that of the document, widened to an active time filter ``from_ms … to_ms``.
    """
    dated = counted_records(lines, filtered).where(F.col("ts_ms").isNotNull())
    whole = dated.agg(F.struct(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))).scalar()
    lo, hi = whole["lo"], whole["hi"]
    if from_ms is not None and to_ms is not None:
        lo, hi = F.least(lo, F.lit(from_ms)), F.greatest(hi, F.lit(to_ms))
    level = F.col("level")
    return (
        dated.withColumn("_off", (F.col("ts_ms") - lo) * bins)
        .withColumn("_span", F.greatest(F.lit(1).cast("bigint"), hi - lo))
        .groupBy(F.least(F.lit(bins - 1).cast("bigint"), F.expr("_off div _span")).cast("int").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("total"), _count_if(level == WARN, "warn"),
            _count_if(level == ERROR, "error"), _count_if(level == FATAL, "fatal"),
        )
    )


LANES = ["total", "warn", "error", "fatal"]


def full_timeline(found: DataFrame, bins: int = TIMELINE_BINS) -> DataFrame:
    """The timeline with its empty bins."""
    every = found.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").na.fill(0, LANES)


def timeline_cumulative(found: DataFrame, bins: int = TIMELINE_BINS) -> DataFrame:
    """Running sums over the bins: ``*_to`` counts the bins up to and including this one."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``bins`` rows
    return full_timeline(found, bins).select("bin", *[F.sum(c).over(upto).alias(f"{c}_to") for c in LANES])


def range_counts(cumulative: DataFrame, first: int, last: int) -> DataFrame:
    """Counts of the bins ``first … last`` from their running sums: two rows are read."""
    ends = cumulative.where(F.col("bin").isin(first - 1, last))
    sign = F.when(F.col("bin") == last, 1).otherwise(-1)
    return ends.agg(*[F.coalesce(F.sum(F.col(f"{c}_to") * sign), F.lit(0)).alias(c) for c in LANES])


def timeline_columns(found: DataFrame, width: int, bins: int = TIMELINE_BINS) -> DataFrame:
    """The timeline drawn ``width`` columns wide: each column sums its bins, at least one.

    ``max_total`` and ``max_alerts`` scale the two lanes.
    """
    x = F.col("id")
    start = F.least(F.floor(x * bins / width), F.lit(bins - 1))
    stop = F.least(F.greatest(F.floor((x + 1) * bins / width), start + 1), F.lit(bins))
    columns = found.sparkSession.range(width).select(
        x.cast("int").alias("x"), F.explode(F.sequence(start.cast("int"), (stop - 1).cast("int"))).alias("bin")
    )
    drawn = (
        columns.join(found, "bin", "left").na.fill(0, LANES)
        .groupBy("x").agg(*[F.sum(c).alias(c) for c in LANES])
    )
    row = Window.partitionBy()  # ``width`` rows
    alerts = F.col("warn") + F.col("error") + F.col("fatal")
    return drawn.select(
        "x", *LANES, F.max("total").over(row).alias("max_total"), F.max(alerts).over(row).alias("max_alerts")
    )
