"""Registered queries: streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import BLOCK, EVENT_LINES, events, original_path, query, scratch, sql, write_files
from lumberline.catalog.views import _KEY, _SPEC, _SPEC_SQL
from lumberline.functions.rules import Rule
from lumberline.operators import stats
from lumberline.sources import views
from lumberline.streaming import appended, live, tail

S = SparkSession
_HALF_HOUR = "30 minutes"


def _tail_slices(spark: S, sf_dir: str) -> list[DataFrame]:
    """The event logs as three deliveries; the first two end within a line of some files."""
    lines = events(spark, sf_dir).select("file_path", "seq", "text")
    top = lines.agg(F.max("seq")).first()[0]
    cuts = [-1, top // 3, 2 * top // 3, top + 1]
    slices = []
    for lo, hi in zip(cuts, cuts[1:]):
        part = lines.where(F.col("seq").between(lo if lo < 0 else lo + 1, hi))
        slices.append(part.select("file_path", F.lit(0).cast("bigint").alias("generation"), (F.col("seq") * 2).alias("seq"), "text", F.lit(True).alias("terminated")))
    # Cut the last line of each file in a delivery in two; its end comes with the next one.
    for i in range(2):
        last = slices[i].groupBy("file_path").agg(F.max("seq").alias("last"))
        marked = slices[i].join(last, "file_path")
        at_cut = F.col("seq") == F.col("last")
        middle = F.floor(F.length("text") / 2).cast("int")
        head = marked.withColumn("terminated", ~at_cut).withColumn("text", F.when(at_cut, F.left("text", middle)).otherwise(F.col("text")))
        rest = marked.where(at_cut).withColumn("text", F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"))
        slices[i] = head.drop("last")
        slices[i + 1] = slices[i + 1].unionByName(rest.drop("last"))
    return slices


def _followed(spark: S, sf_dir: str) -> tail.LogTable:
    inbox, folder = scratch(spark, "inbox"), scratch(spark, "tail")
    for part in _tail_slices(spark, sf_dir):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(part.schema).parquet(inbox)
        tail.stream_records(stream, folder, availableNow=True).awaitTermination()
    return tail.LogTable(spark, folder)


@query("T1_stream_records", sql("SELECT file_path, line_no, text, logical_id, ts_ms, level, is_plain FROM lines"))
def stream_records(spark: S, sf_dir: str) -> DataFrame:
    lines = _followed(spark, sf_dir).lines().where("not provisional")
    return lines.select("file_path", "line_no", "text", "logical_id", "ts_ms", "level", "is_plain")


@query("T2_unfinished_lines", sql("""SELECT file_path, count(*) AS lines, CAST(1 AS BIGINT) AS unfinished FROM lines
  WHERE seq <= (SELECT max(seq) // 3 FROM lines) GROUP BY file_path"""))
def unfinished(spark: S, sf_dir: str) -> DataFrame:
    table = tail.LogTable(spark, scratch(spark, "tail"))
    tail.append_batch(table, _tail_slices(spark, sf_dir)[0], 0)
    return table.lines().groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.count_if("provisional").alias("unfinished"))


def _written(lines: DataFrame, upto: int | None) -> DataFrame:
    """The bytes of the files once all lines to ``upto`` are written, and half of the next; or all lines, the last one without its end."""
    if upto is None:
        last = lines.groupBy("file_path").agg(F.max("seq").alias("last"))
        rows, text = lines.join(last, "file_path"), F.col("text")
    else:
        last = lines.where(F.col("seq") > upto).groupBy("file_path").agg(F.min("seq").alias("last"))
        rows = lines.join(last, "file_path").where(F.col("seq") <= F.col("last"))
        text = F.when(F.col("seq") < F.col("last"), F.col("text")).otherwise(F.left(F.col("text"), F.floor(F.length("text") / 2).cast("int")))
    return rows.select("file_path", "seq", F.concat(text, F.when(F.col("seq") < F.col("last"), "\n").otherwise("")).alias("data"))


def _grown(spark: S, sf_dir: str, deliveries: int) -> DataFrame:
    """The table of a stream that follows the event logs while they grow: cut within lines after each third, then whole."""
    lines = events(spark, sf_dir).select("file_path", "seq", "text")
    top = lines.agg(F.max("seq")).first()[0]
    folder, table = scratch(spark, "growing"), scratch(spark, "followed")
    for upto in [top // 3, 2 * top // 3, None][:deliveries]:
        write_files(_written(lines, upto), folder)
        appended.follow(spark, folder, table, availableNow=True).awaitTermination()
    found = tail.LogTable(spark, table).lines()
    return found.select(original_path("/logs").alias("file_path"), "line_no", "text", "logical_id", "ts_ms", "provisional")


@query("S10_appended_bytes", sql("""SELECT file_path, line_no, text, logical_id, ts_ms, line_no = max(line_no) OVER (PARTITION BY file_path) AS provisional FROM lines"""))
def appended_bytes(spark: S, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, 3)


@query("T2_open_lines", sql("""SELECT file_path, line_no, text, open AS provisional FROM (
  SELECT file_path, line_no, CASE WHEN seq = nxt THEN substr(text, 1, length(text) // 2) ELSE text END AS text, coalesce(seq = nxt, false) AS open
  FROM (SELECT *, min(CASE WHEN seq > top // 3 THEN seq END) OVER (PARTITION BY file_path) AS nxt FROM (SELECT *, max(seq) OVER () AS top FROM lines))
  WHERE seq <= nxt)"""))
def open_lines(spark: S, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, 1).select("file_path", "line_no", "text", "provisional")


@query("T3_replaced_files", sql("SELECT file_path, count(*) AS lines, count(ts_ms) AS dated FROM lines GROUP BY file_path"))
def replaced(spark: S, sf_dir: str) -> DataFrame:
    table = tail.LogTable(spark, scratch(spark, "tail"))
    tail.append_batch(table, _tail_slices(spark, sf_dir)[0], 0)
    whole = events(spark, sf_dir).select(
        "file_path", F.lit(1).cast("bigint").alias("generation"), "seq", "text", F.lit(True).alias("terminated"))
    tail.append_batch(table, whole, 1)
    return table.lines().groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.count("ts_ms").alias("dated"))


def _event_stream(spark: S, sf_dir: str) -> tuple[DataFrame, str]:
    inbox = scratch(spark, "stored-lines")
    log = events(spark, sf_dir)
    log.write.parquet(inbox)
    return spark.readStream.schema(log.schema).parquet(inbox), scratch(spark, "live")


def _kept(view: DataFrame, folder: str) -> DataFrame:
    spark = view.sparkSession
    view.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(view.schema).parquet(f"{folder}/rows")


@query("S10_stream_source", sql("SELECT text, count(*) AS n FROM raw GROUP BY text"))
def stream_source(spark: S, sf_dir: str) -> DataFrame:
    inbox, folder = scratch(spark, "log-inbox"), scratch(spark, "live")
    views.event_lines(spark, sf_dir, BLOCK).select("text").write.text(inbox)
    stream = tail.read_log_stream(spark, inbox, "*.txt").select("text")
    return _kept(stream, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("F11_stream_filter", sql(_KEY + _SPEC_SQL))
def stream_filter(spark: S, sf_dir: str) -> DataFrame:
    stream, folder = _event_stream(spark, sf_dir)
    return _kept(live.live_view(stream, _SPEC).select("file_path", "line_no"), folder)


@query("T4_live_view", sql(f"""SELECT file_path, line_no, CASE WHEN contains(lower(text), 'at app') THEN 'red' END AS marker FROM lines WHERE {_SPEC_SQL}"""))
def live_view(spark: S, sf_dir: str) -> DataFrame:
    stream, folder = _event_stream(spark, sf_dir)
    view = live.live_view(stream, _SPEC, [Rule("at app", color="red")])
    return _kept(view.select("file_path", "line_no", "marker"), folder)


@query("T5_stream_timeline", sql("""SELECT ts_ms // 1800000 * 1800000 AS window_ms, count(*) AS total, count(*) FILTER (WHERE level = 4) AS warn,
  count(*) FILTER (WHERE level = 5) AS error, count(*) FILTER (WHERE level = 6) AS fatal FROM heads WHERE ts_ms IS NOT NULL GROUP BY 1"""))
def stream_timeline(spark: S, sf_dir: str) -> DataFrame:
    stream, folder = _event_stream(spark, sf_dir)
    heads = stream.where("is_primary").withColumn("ts", F.timestamp_millis("ts_ms"))
    live.write_updates(live.stream_timeline(heads, _HALF_HOUR), folder, ["window_start"], availableNow=True).awaitTermination()
    found = live.latest_updates(spark, folder, ["window_start"])
    return found.withColumn("window_ms", F.unix_millis("window_start")).drop("window_start")


@query("T6_stream_stats", sql("SELECT level, count(*) AS records FROM heads GROUP BY level"))
def stream_stats(spark: S, sf_dir: str) -> DataFrame:
    stream, folder = _event_stream(spark, sf_dir)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    live.stream_stats(
        stream, folder, lambda: spark.read.parquet(f"{folder}/table/batch=*"), append, stats.level_counts, availableNow=True
    ).awaitTermination()
    return live.latest_report(spark, folder).select("level", "records")


@query("T7_stream_merge", sql("SELECT file_path, line_no, row_no FROM placed", EVENT_LINES))
def stream_merge(spark: S, sf_dir: str) -> DataFrame:
    from lumberline.operators.order import with_row_no

    log = events(spark, sf_dir)
    inboxes = [scratch(spark, "merge-inbox") for _ in range(2)]
    early = F.col("file_path").isin("/logs/app0.log", "/logs/app1.log")
    for inbox, part in zip(inboxes, (log.where(early), log.where(~early))):
        part.write.parquet(inbox)
    merged = live.stream_merge([spark.readStream.schema(log.schema).parquet(i) for i in inboxes])
    stored = _kept(merged, scratch(spark, "live"))
    return with_row_no(stored).select("file_path", "line_no", "row_no")
