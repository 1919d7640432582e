"""Synthetic logs for tests and benches: the same for the same seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.detect import ms_text

START_MS = 1_750_002_345_000  # 2025-06-15 15:45:45
WEIGHTS = {"TRACE": 40, "DEBUG": 210, "INFO": 560, "WARN": 120, "ERROR": 60, "FATAL": 10}  # in a thousand

_COMPONENTS = ["ferry.dock", "tide.table", "lantern", "harbour.crane", "ledger"]
_MESSAGES = [
    "crane lifted {a} crates, {b} remain", "tide gauge {c} reads {d} cm", "ledger page {a} closed with {b} entries",
    "паром {c} отошёл с {b} пассажирами", "lamp {d} dimmed to {c}",
]
_FAILURES = ["berth {c} is taken by ferry {d}", "crate {a} lost overboard", "Канат {d} оборван"]
BLOCK_RECORDS = 1 << 14


def _draw(seed: int, name: str, n: int, *more: Column) -> Column:
    """A number in ``[0, n)`` that depends on the record, the seed and the name only."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(name), *more), F.lit(n))


def _choice(options: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), at.cast("int"))


def _filled(template: Column, seed: int) -> Column:
    out = template
    for name, n in (("a", 100_000), ("b", 5_000), ("c", 256), ("d", 256)):
        out = F.replace(out, F.lit("{" + name + "}"), _draw(seed, name, n).cast("string"))
    return out


def synth_lines(
    spark: SparkSession, records: int, seed: int = 0, file_path: str = "/synth.log", multiline_percent: int = 5
) -> DataFrame:
    """Lines ``(file_path, block, seq, text)`` of a log with some multi-line records.

    Each record starts up to 1.5 s after the one before; its time is the sum of the steps, which are
    spread evenly so that no running sum over the whole log is needed.
    """
    point = _draw(seed, "level", 1000)
    level, below = F.lit("FATAL"), 1000
    for name in reversed(list(WEIGHTS)[:-1]):
        below -= WEIGHTS[list(WEIGHTS)[list(WEIGHTS).index(name) + 1]]
        level = F.when(point < below, F.lit(name)).otherwise(level)
    head = spark.range(records).withColumn("level", level)
    bad = F.col("level").isin("ERROR", "FATAL")
    template = F.when(bad, _choice(_FAILURES, _draw(seed, "failure", len(_FAILURES)))).otherwise(
        _choice(_MESSAGES, _draw(seed, "message", len(_MESSAGES))))
    step = F.col("id") * 750 + _draw(seed, "step", 750)
    head = head.withColumn("message", _filled(template, seed)).withColumn("ms", step + START_MS)
    first = F.concat(
        ms_text(F.col("ms")), F.lit(" "), F.col("level"), F.lit(" ["),
        _choice(_COMPONENTS, _draw(seed, "component", len(_COMPONENTS))), F.lit("] "), F.col("message"),
    )
    depth = F.when(_draw(seed, "deep", 100) < multiline_percent, 2 + _draw(seed, "depth", 5)).otherwise(0)
    frames = F.transform(
        F.sequence(F.lit(1), depth.cast("int")),
        lambda k: F.concat(F.lit("    at harbour.Crane.lift(Crane.java:"), (k * 17).cast("string"), F.lit(")")),
    )
    more = F.when(depth > 0, F.concat(F.array(F.concat(F.lit("harbour.CargoException: "), F.col("message"))), frames))
    lines = F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>")))
    return head.select(
        F.lit(file_path).alias("file_path"), F.floor(F.col("id") / BLOCK_RECORDS).alias("block"),
        "id", F.posexplode(lines).alias("part", "text"),
    ).select("file_path", "block", (F.col("id") * 16 + F.col("part")).alias("seq"), "text")


def write_synth_log(lines: DataFrame, path: str, line_end: str = "\n") -> None:
    """Write the lines in order as text files with the given line ends."""
    lines.orderBy("file_path", "seq").select("text").write.option("lineSep", line_end).text(path)
