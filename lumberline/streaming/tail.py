"""Following files that grow: records across micro-batches.

A stream delivers ``(file_path, generation, seq, text, terminated)``: the lines of a file in the
order of ``seq``, ``terminated=false`` for a last piece without its newline, and a new
``generation`` when the file was replaced.  Text files deliver ``segment, offset`` in place of
``seq``: a piece of a file, and where a run of its lines starts.

Every micro-batch is a batch job with the same two-step numbering as for files, so that a file that
brings a third of all lines is still spread over many tasks.  What a file's next lines continue is
one row per file, written next to the lines and keyed by the batch: a batch that is run again after
a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lumberline.functions.detect import classify
from lumberline.operators.records import START, assign_records, last_context
from lumberline.session import pinned

STATE = (
    "file_path string, generation bigint, start_line bigint, start_id bigint, start_ms bigint, "
    "start_level int, tail string"
)
BLOCK_LINES = 1 << 16


def read_log_stream(spark: SparkSession, folder: str, suffix: str = "*.log", **options: str) -> DataFrame:
    """Lines of the files that appear in a folder, each file one segment of a log.

    The segments of one log share its name up to the first ``@``: ``app.log@0001.log``, ….
    """
    raw = spark.readStream.options(lineSep="\n", pathGlobFilter=suffix, **options).text(folder)
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_replace(path, "@[^/]*$", "").alias("file_path"),
        F.lit(0).cast("bigint").alias("generation"),
        path.alias("segment"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
        F.lit(True).alias("terminated"),
    )


class LogTable:
    """The lines and the per-file state that a tailing stream writes below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.folder}/{part}").parquet(f"{self.folder}/{part}/batch=*")
        except AnalysisException:
            return None

    def state(self, after: int | None = None) -> DataFrame:
        """One row per file, as of the end of a batch; of the last one if none is named.

        Every batch writes the state of all files, so that one folder is read however many batches
        there were.
        """
        if after is not None and after < 0:
            return self.spark.createDataFrame([], STATE)
        if after is not None:
            return self.spark.read.schema(STATE).parquet(f"{self.folder}/state/batch={after}")
        rows = self._read("state")
        if rows is None:
            return self.spark.createDataFrame([], STATE)
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")

    def lines(self) -> DataFrame:
        """The lines of the current generation of every file, with unfinished last lines flagged."""
        state = self.state().select("file_path", "generation", *[F.col(c) for c in ("start_line", "start_id", "tail")])
        current = state.select("file_path", "generation")
        stored = self._read("lines")
        if stored is None:
            return self._unfinished()
        stored = stored.join(current, ["file_path", "generation"], "left_semi")
        return stored.withColumn("provisional", F.lit(False)).unionByName(
            self._unfinished(), allowMissingColumns=True
        )

    def _unfinished(self) -> DataFrame:
        held = self.state().where(F.col("tail").isNotNull())
        pieces = held.select("file_path", "generation", F.lit(0).alias("block"), F.lit(0).alias("seq"), F.col("tail").alias("text"))
        return assign_records(classify(pieces), start=held).withColumn("provisional", F.lit(True)).drop("block", "seq")

    def write(self, part: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/batch={batch}")


def _stage(batch: DataFrame, path: str) -> DataFrame:
    """Write a micro-batch in the order of its files, cut into blocks of bounded size.

    A micro-batch arrives in any order, so that its lines are range-sorted; the sort decides the
    blocks and spreads a large file over many of them.  Everything that follows reads the written
    rows, so that all of it sees the same blocks.
    """
    placed = batch.repartitionByRange("file_path", "seq").sortWithinPartitions("file_path", "seq")
    at = F.monotonically_increasing_id()
    blocks = placed.withColumn("seq", at).withColumn("block", F.floor(F.col("seq") / BLOCK_LINES))
    blocks.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.parquet(path)


def append_batch(table: LogTable, batch: DataFrame, batch_id: int) -> None:
    """Add one micro-batch to the table.

    A line is built from the piece held back before and the first piece now; a last piece without
    newline is held back.  A file whose generation is newer than the state starts afresh.
    """
    state = table.state(after=batch_id - 1)
    if batch.isEmpty():
        table.write("state", state, batch_id)
        return
    if "seq" not in batch.columns:
        seq = F.struct("segment", "offset", F.monotonically_increasing_id().alias("at"))
        batch = batch.withColumn("seq", seq).drop("segment", "offset")
    staged = _stage(batch, f"{table.folder}/staged/batch={batch_id}")

    # One row per file: its generation, the edges of its pieces, and what was known of it.
    edges = staged.groupBy("file_path", "generation").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("terminated", "seq").alias("whole")
    )
    newest = Window.partitionBy("file_path").orderBy(F.desc("generation"))
    edges = edges.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")
    old = state.withColumnsRenamed({"generation": "old_generation", "tail": "old_tail"})
    edges = edges.join(old, "file_path", "left").where(
        F.col("old_generation").isNull() | (F.col("generation") >= F.col("old_generation"))
    )
    goes_on = F.col("generation") == F.col("old_generation")
    files = pinned(edges.withColumns({c: F.when(goes_on, F.col(c)) for c in (*START, "old_tail")}).drop("old_generation"))

    rows = staged.join(files.select("file_path", "generation", "first_seq", "last_seq", "whole", "old_tail"),
                       ["file_path", "generation"])
    opened = (F.col("seq") == F.col("first_seq")) & F.col("old_tail").isNotNull()
    # The two bytes of a line end may have come one by one.
    joined = F.concat("old_tail", "text")
    joined = F.when(F.col("terminated") & joined.endswith("\r"), F.substring(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined)
    rows = rows.withColumn("text", F.when(opened, joined).otherwise(F.col("text")))
    held = ~F.col("whole") & (F.col("seq") == F.col("last_seq"))
    finished = rows.where(~held).select("file_path", "generation", "block", "seq", "text")
    lines = assign_records(classify(finished), start=files)
    table.write("lines", lines.drop("block", "seq"), batch_id)

    context = last_context(table.spark.read.parquet(f"{table.folder}/lines/batch={batch_id}"))
    tails = rows.where(held).select("file_path", F.col("text").alias("tail"))
    before = files.select("file_path", "generation", *[F.col(c).alias(f"old_{c}") for c in START])
    after = before.join(context, "file_path", "left").join(tails, "file_path", "left")
    known = F.col("start_line").isNotNull()
    columns = [F.when(known, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in START]
    changed = after.select("file_path", "generation", *columns, "tail")
    others = state.join(files, "file_path", "left_anti")
    table.write("state", changed.unionByName(others), batch_id)


def stream_records(stream: DataFrame, folder: str, **trigger: object) -> StreamingQuery:
    """Follow a stream of lines into the table at ``folder``."""
    table = LogTable(stream.sparkSession, folder)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, batch_id: append_batch(table, batch, batch_id)).start()
