"""Live views: filters, timeline and statistics that follow a growing log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumberline.functions.detect import ERROR, FATAL, WARN
from lumberline.functions.rules import Rule
from lumberline.operators.filters import FilterSpec, apply_filters
from lumberline.operators.marks import mark_rows


def live_view(stream: DataFrame, spec: FilterSpec, patterns: list[Rule] | None = None) -> DataFrame:
    """The rows of a stream that pass the filters, with their markers.

    Every row is judged by itself, so that only new rows are looked at.
    """
    view = apply_filters(stream, spec)
    return mark_rows(view, patterns) if patterns else view


def stream_timeline(stream: DataFrame, window: str = "1 minute") -> DataFrame:
    """Records, warnings, errors and fatals per window of event time, from a stream of record heads.

    There is no watermark, so that a record counts however late it comes.  The state is one row of
    counts per window; ``write_updates`` keeps what each batch changed.
    """
    level = F.col("level")
    return (
        stream.where(F.col("ts").isNotNull())
        .groupBy(F.window("ts", window))
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(level == WARN).alias("warn"),
            F.count_if(level == ERROR).alias("error"), F.count_if(level == FATAL).alias("fatal"),
        )
        .select(F.col("window.start").alias("window_start"), "total", "warn", "error", "fatal")
    )


def write_updates(aggregate: DataFrame, folder: str, keys: list[str], **trigger: object) -> StreamingQuery:
    """Keep the updates of a streaming aggregate as a table; ``latest_updates`` reads its state."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id}")

    writer = aggregate.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(keep).start()


def latest_updates(spark, folder: str, keys: list[str]) -> DataFrame:
    """The latest row of every key of a table of updates."""
    rows = spark.read.option("basePath", f"{folder}/updates").parquet(f"{folder}/updates/batch=*")
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")


def stream_stats(
    stream: DataFrame, folder: str, table: Callable[[], DataFrame], append: Callable[[DataFrame, int], None],
    report: Callable[[DataFrame], DataFrame], **trigger: object,
) -> StreamingQuery:
    """After each micro-batch is appended, compute a report over the whole stored table.

    Reports are kept per batch below ``folder``; the last one is current.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        append(batch, batch_id)
        report(table()).write.mode("overwrite").parquet(f"{folder}/report/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint-report")
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(step).start()


def latest_report(spark, folder: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/report").parquet(f"{folder}/report/batch=*")
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch")


def stream_merge(streams: list[DataFrame]) -> DataFrame:
    """Several logs as one stream.

    Late rows need no special path: rows are appended as they come, and reading the stored table in
    document order puts each in its place.
    """
    merged = streams[0]
    for stream in streams[1:]:
        merged = merged.unionByName(stream)
    return merged
