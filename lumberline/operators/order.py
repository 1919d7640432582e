"""Total order of a document, positions in it, and seeks by time, text or record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.detect import WARN
from lumberline.functions.rules import contains_literal
from lumberline.session import pinned

POSITION = ["ts_ms", "file_path", "logical_id", "line_no"]
HOUR_MS = 3_600_000
MOST_OFFSETS = 200_000  # partitions whose offsets are broadcast, a few megabytes


def order_columns() -> list[Column]:
    return [F.col("ts_ms").asc_nulls_last(), F.col("file_path"), F.col("logical_id"), F.col("line_no")]


def ordered(lines: DataFrame) -> DataFrame:
    """The document in its order: time, then file, record and line; lines without time last."""
    return lines.orderBy(*order_columns())


def position() -> Column:
    """A struct that sorts like the document order (a null time would otherwise come first)."""
    return F.struct(F.col("ts_ms").isNull().alias("undated"), *POSITION)


def with_row_no(lines: DataFrame) -> DataFrame:
    """Add ``row_no``, counted from 0 in document order.

    A range sort puts the rows into ordered partitions, which are written to the checkpoint folder
    so that counting and numbering see the same ones.  Only one row per partition is summed up.
    """
    parts = pinned(ordered(lines)).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One narrow row per partition of the sort; so few need no second shuffle of the rows.
    few = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= MOST_OFFSETS
    return (
        parts.join(F.broadcast(offsets) if few else offsets, "_part")
        .withColumn("row_no", F.col("_at") - F.col("_from") + F.col("_before"))
        .drop("_part", "_at", "_from", "_before")
    )


def time_range(lines: DataFrame) -> DataFrame:
    return lines.agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"))


def sample_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of the document that are not blank."""
    return ordered(lines.where(F.trim("text") != "")).limit(n)


# ---- nearest rows ------------------------------------------------------------------------------


def _as_of(rows: DataFrame, probes: DataFrame, width: int, forward: bool) -> DataFrame:
    """For every probe ``(probe, at)`` the nearest ``value`` among rows ``(at, value)``.

    Forward finds the first row at or after the probe, backward the last one before it.  Rows are
    first reduced to one per distinct ``at``, so that a bucket of ``width`` holds at most ``width``
    of them however many rows share a moment.  What a bucket lacks comes from the nearest bucket
    that has rows; that step sees one row per bucket.
    """
    bucket = F.floor(F.col("at") / width).alias("bucket")
    side = rows.groupBy("at").agg((F.min if forward else F.max)("value").alias("value"))
    both = side.select(bucket, "at", "value", F.lit(None).cast("bigint").alias("probe"), F.lit(0).alias("asks"))
    asked = probes.select(bucket, "at", "probe", F.lit(1).alias("asks"))
    both = both.unionByName(asked, allowMissingColumns=True)

    # Forward looks from the end; in both directions a frame that only grows needs one pass.  A row
    # at the probe's own moment counts forward, not backward.
    toward = [F.desc("at"), F.asc("asks")] if forward else [F.asc("at"), F.desc("asks")]
    seen = Window.partitionBy("bucket").orderBy(*toward).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("near", F.last("value", ignorenulls=True).over(seen)).where("asks = 1")

    edge = F.min_by if forward else F.max_by
    edges = both.groupBy("bucket").agg(edge("value", F.when(F.col("asks") == 0, F.col("at"))).alias("edge"))
    beyond = Window.orderBy(F.desc("bucket") if forward else F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("bucket", F.last("edge", ignorenulls=True).over(beyond).alias("far"))
    return inside.join(carried, "bucket").select("probe", "at", F.coalesce("near", "far").alias("value"))


def _dated(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("ts_ms").isNotNull()).select(F.col("ts_ms").alias("at"), position().alias("value"))


def seek_time(lines: DataFrame, probes: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """For probes ``(probe, at)`` the first row at or after each time; else the first without time."""
    found = _as_of(_dated(lines), probes, width, forward=True)
    undated = lines.where(F.col("ts_ms").isNull()).agg(F.min(position()).alias("first"))
    value = F.coalesce(F.col("value"), undated.scalar())
    return found.select("probe", "at", *[value[c].alias(c) for c in POSITION])


def seek_error(lines: DataFrame, probes: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """For each probe the nearest row of level Warn or worse.

    The row at the probe's time wins if it is such a row; at equal distance the earlier row wins; a
    document without any such row leaves the row by time.
    """
    errors = _dated(lines.where(F.col("level") >= WARN))
    by_time = seek_time(lines, probes, width).select("probe", "at", F.struct(*POSITION).alias("row"))
    after = _as_of(errors, probes, width, forward=True).select("probe", F.col("value").alias("after"))
    before = _as_of(errors, probes, width, forward=False).select("probe", F.col("value").alias("before"))
    near, far = F.col("before"), F.col("after")
    on_row = F.struct(*[far[c].alias(c) for c in POSITION]) == F.col("row")
    closer = (F.col("at") - near["ts_ms"]) <= (far["ts_ms"] - F.col("at"))
    pick = F.when(on_row, far).when(near.isNotNull() & (far.isNull() | closer), near).otherwise(far)
    joined = by_time.join(after, "probe").join(before, "probe").withColumn("pick", pick)
    return joined.select("probe", "at", *[F.coalesce(F.col("pick")[c], F.col("row")[c]).alias(c) for c in POSITION])


def _numbered_hits(view: DataFrame, text: str, case_sensitive: bool) -> DataFrame:
    """Positions and whether the line contains the text; the texts themselves are not sorted."""
    return with_row_no(view.select(*POSITION, contains_literal(F.col("text"), text, case_sensitive).alias("hit")))


def find_next(view: DataFrame, text: str, row: int, case_sensitive: bool = False, wrap: bool = True) -> DataFrame:
    """Position of the next line after ``row`` that contains the text; null if there is none."""
    hits = _numbered_hits(view, text, case_sensitive).where("hit")
    at = F.col("row_no")
    found = hits.agg(F.min(F.when(at > row, at)).alias("ahead"), F.min(F.when(at <= row, at)).alias("wrapped"))
    return found.select((F.coalesce("ahead", "wrapped") if wrap else F.col("ahead")).alias("row_no"))


def find_previous(view: DataFrame, text: str, row: int, case_sensitive: bool = False, wrap: bool = True) -> DataFrame:
    """Position of the last line before ``row`` that contains the text; a row outside the view means its end."""
    numbered = _numbered_hits(view, text, case_sensitive)
    at, hit = F.col("row_no"), F.col("hit")
    found = numbered.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(hit & (at < row), at)).alias("behind"),
        F.max(F.when(hit & (at >= row), at)).alias("wrapped"),
        F.max(F.when(hit, at)).alias("last"),
    )
    inside = (F.lit(row) >= 0) & (F.lit(row) < F.col("n"))
    back = F.coalesce("behind", "wrapped") if wrap else F.col("behind")
    return found.select(F.when(inside, back).otherwise(F.col("last")).alias("row_no"))


def locate_records(lines: DataFrame, visible: Column, keys: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Where to go for records ``(probe, file_path, logical_id)`` in a view of the document.

    The first visible row of the record; if all its rows are hidden, the next visible row, or the
    last one before it.
    """
    rows = with_row_no(lines.withColumn("_visible", visible).select("_visible", *POSITION))
    place = F.struct("file_path", "line_no")
    starts = (
        rows.join(keys, ["file_path", "logical_id"])
        .groupBy("probe")
        .agg(
            F.min("row_no").alias("at"),
            F.min_by(place, F.when(F.col("_visible"), F.col("row_no"))).alias("own"),
        )
    )
    shown = rows.where("_visible").select(F.col("row_no").alias("at"), place.alias("value"))
    hidden = starts.where(F.col("own").isNull())
    after = _as_of(shown, hidden, width, forward=True).select("probe", F.col("value").alias("after"))
    before = _as_of(shown, hidden, width, forward=False).select("probe", F.col("value").alias("before"))
    found = starts.join(after, "probe", "left").join(before, "probe", "left")
    pick = F.coalesce("own", "after", "before")
    return found.select("probe", pick["file_path"].alias("file_path"), pick["line_no"].alias("line_no"))
