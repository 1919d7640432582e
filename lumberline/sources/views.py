"""Log views over relational tables: every row of a table rendered as lines of text.

A view is a table ``(file_path, block, seq, text)``.  ``seq`` orders the lines of a file and
``block`` cuts the file into runs of bounded length, as splits do for text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.detect import DAY_MS, classify, ms_text, ntz_to_ms
from lumberline.operators.records import assign_records

BLOCK_SEQ = 1 << 16
START_MS = 1_704_067_200_000  # 2024-01-01 00:00


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_busy_hours(events: DataFrame) -> DataFrame:
    """Add ``log_ms``: event time squeezed into three hours of a day, the first ten days stretched sixfold.

    Uniform events have no silences, bursts or trends; the squeezed ones have all of them.  Each
    step is a column of its own, or the next step would repeat its expression many times over.
    """
    offset, in_day, squeezed = F.col("_offset"), F.col("_in_day"), F.col("_squeezed")
    return (
        events.withColumn("_offset", ntz_to_ms(F.col("ts")) - START_MS)
        .withColumn("_in_day", F.pmod(offset, F.lit(DAY_MS)))
        .withColumn("_squeezed", offset - in_day + F.floor(in_day / 8))
        .withColumn(
            "log_ms",
            F.when(squeezed < 10 * DAY_MS, squeezed * 6).otherwise(squeezed + 50 * DAY_MS) + START_MS,
        )
    )


def event_level(kind: Column, value: Column) -> Column:
    return (
        F.when((kind == "error") & (value >= 200), "FATAL")
        .when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind == "signup", "DEBUG")
        .when((kind == "view") & (value >= 100), "TRACE")
        .otherwise("INFO")
    )


def event_file(user_id: Column) -> Column:
    return F.concat(F.lit("/logs/app"), F.pmod(user_id, F.lit(4)).cast("string"), F.lit(".log"))


def event_lines(spark: SparkSession, sf_dir: str, block_seq: int = BLOCK_SEQ) -> DataFrame:
    """``events`` as application logs: one line per event, two more for the stack of an error.

    Each file opens with a line that is no record.
    """
    events = with_busy_hours(table(spark, sf_dir, "events"))
    kind, value = F.col("event_type"), F.col("value")
    rendered = events.withColumn("_head", F.concat(
        ms_text(F.col("log_ms")), F.lit(" "), event_level(kind, value),
        F.lit(" ["), kind, F.lit("] user "), F.col("user_id").cast("string"),
        F.lit(" value="), value.cast("decimal(12,2)").cast("string"),
        F.lit(" props="), F.col("props"),
    ))
    stack = F.array(
        F.concat(F.lit("app.EventException: event "), F.col("event_id").cast("string"), F.lit(" failed")),
        F.concat(F.lit("    at app.Events.handle(Events.java:"), F.col("user_id").cast("string"), F.lit(")")),
    )
    head = F.col("_head")
    texts = F.when(kind == "error", F.concat(F.array(head), stack)).otherwise(F.array(head))
    body = rendered.select(
        event_file(F.col("user_id")).alias("file_path"), "event_id", F.posexplode(texts).alias("part", "text")
    ).select("file_path", (F.col("event_id") * 4 + F.col("part")).alias("seq"), "text")
    opening = (
        events.select(event_file(F.col("user_id")).alias("file_path")).distinct()
        .select("file_path", F.lit(-1).cast("bigint").alias("seq"), F.lit("log opened by collector").alias("text"))
    )
    return body.unionByName(opening).withColumn("block", F.floor(F.col("seq") / block_seq))


def event_log(spark: SparkSession, sf_dir: str, block_seq: int = BLOCK_SEQ) -> DataFrame:
    """The classified lines of the event logs, grouped into records."""
    return assign_records(classify(event_lines(spark, sf_dir, block_seq)))


def document_lines(spark: SparkSession, sf_dir: str, block_seq: int = BLOCK_SEQ) -> DataFrame:
    """``documents`` as text files, one per source: the lines of its documents one after another."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select(
            F.concat(F.lit("/texts/"), F.col("source"), F.lit(".txt")).alias("file_path"),
            "doc_id",
            F.posexplode(F.split(F.col("text"), "\n", -1)).alias("part", "text"),
        )
        .select("file_path", (F.col("doc_id") * (1 << 20) + F.col("part")).alias("seq"), "text")
        .withColumn("block", F.floor(F.col("seq") / (block_seq << 10)))
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_records(classify(document_lines(spark, sf_dir)))


def bracket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as ``[time] [LEVEL] message`` lines, cut short where the order is still open."""
    at = ntz_to_ms(F.col("o_orderdate")) + F.pmod(F.col("o_orderkey"), F.lit(DAY_MS))
    orders = table(spark, sf_dir, "orders").withColumn("_at", at)
    level = F.when(F.col("o_orderpriority").startswith("1"), "ERROR").when(
        F.col("o_orderpriority").startswith("2"), "WARN").otherwise("INFO")
    stamp = ms_text(F.col("_at"), ".")
    tail = F.concat(
        F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" total "),
        F.col("o_totalprice").cast("decimal(14,2)").cast("string"),
    )
    text = F.when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("["), stamp, F.lit("] unreadable "), tail)
    ).otherwise(F.concat(F.lit("["), stamp, F.lit("] ["), level, F.lit("] "), tail))
    return orders.select(
        F.concat(F.lit("/logs/orders"), F.pmod(F.col("o_custkey"), F.lit(3)).cast("string"), F.lit(".log")).alias("file_path"),
        F.floor(F.col("o_orderkey") / BLOCK_SEQ).alias("block"),
        F.col("o_orderkey").alias("seq"),
        text.alias("text"),
    )


def pipe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows as ``a | b | c | message`` lines."""
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(
        F.col("l_orderkey").cast("string"), F.lit(" | "), F.col("l_returnflag"), F.lit(" | "),
        F.col("l_linestatus"), F.lit(" | part "), F.col("l_partkey").cast("string"), F.lit(" qty "),
        F.col("l_quantity").cast("decimal(12,2)").cast("string"),
    )
    return li.select(
        F.lit("/logs/items.log").alias("file_path"),
        F.floor(F.col("l_orderkey") / BLOCK_SEQ).alias("block"),
        (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("seq"),
        text.alias("text"),
    )


def thread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as ``time [thread] LEVEL - message`` lines; returned items have lost the brackets."""
    at = ntz_to_ms(F.col("l_shipdate")) + F.pmod(F.col("l_orderkey"), F.lit(DAY_MS))
    li = table(spark, sf_dir, "lineitem").withColumn("_at", at)
    thread = F.concat(F.lit("worker-"), F.pmod(F.col("l_suppkey"), F.lit(8)).cast("string"))
    level = F.when(F.col("l_returnflag") == "A", "ERROR").otherwise("INFO")
    text = F.concat(
        ms_text(F.col("_at")), F.lit(" "),
        F.when(F.col("l_returnflag") == "R", thread).otherwise(F.concat(F.lit("["), thread, F.lit("]"))),
        F.lit(" "), level, F.lit(" - part "), F.col("l_partkey").cast("string"),
        F.lit(" qty "), F.col("l_quantity").cast("decimal(12,2)").cast("string"),
    )
    return li.select(
        F.lit("/logs/workers.log").alias("file_path"),
        F.floor(F.col("l_orderkey") / BLOCK_SEQ).alias("block"),
        (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("seq"),
        text.alias("text"),
    )


def stamp_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of ``events`` written in every accepted form and in some refused ones."""
    events = table(spark, sf_dir, "events").withColumn("_ms", ntz_to_ms(F.col("ts"))).withColumn(
        "_t", ms_text(F.col("_ms"), ""))
    t, form = F.col("_t"), F.pmod(F.col("event_id"), F.lit(10))
    year, month, day, clock = F.left(t, F.lit(4)), F.substring(t, 6, 2), F.substring(t, 9, 2), F.substring(t, 12, 8)
    text = (
        F.when(form == 0, t)
        .when(form == 1, F.concat(F.lit("x "), F.replace(t, F.lit(" "), F.lit("T")), F.lit(",7 WARN")))
        .when(form == 2, F.concat(t, F.lit(".1234 INFO")))
        .when(form == 3, F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(" "), clock, F.lit(" Error")))
        .when(form == 4, F.concat(month, F.lit("/"), day, F.lit("/"), year, F.lit(" "), clock))
        .when(form == 5, F.concat(day, F.lit("."), month, F.lit("."), year, F.lit(" "), clock, F.lit(" INFOS debug")))
        .when(form == 6, F.concat(year, F.lit("-02-30 "), clock, F.lit(" then "), t))
        .when(form == 7, F.concat(F.lit("at "), day, F.lit("/"), month, F.lit("/"), year, F.lit(" "), clock))
        .when(form == 8, F.concat(t, F.lit(".99999999999 fatal_error FATAL")))
        .otherwise(F.concat(F.lit("9"), t, F.lit(". dot")))
    )
    return events.select("event_id", text.alias("text"))


DUMP_START = "2024-01-01 00:00:00,000 INFO [dump] "


def dump_lines(spark: SparkSession, sf_dir: str, block_seq: int = BLOCK_SEQ) -> DataFrame:
    """``lineitem`` as one record that never ends: a first line with a time, then a line per order and line number."""
    opening = spark.range(1).select(
        F.lit("/dumps/items.log").alias("file_path"), F.lit(-1).cast("bigint").alias("seq"), F.lit(DUMP_START + "all items").alias("text"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("qty"))
    text = F.concat_ws(" | ", F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("rows "), F.col("n")), F.concat(F.lit("qty "), F.col("qty")))
    rows = items.select(F.lit("/dumps/items.log").alias("file_path"), (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("seq"), text.alias("text"))
    return rows.unionByName(opening).withColumn("block", F.floor(F.col("seq") / block_seq))


def json_dump_lines(spark: SparkSession, sf_dir: str, block_seq: int = BLOCK_SEQ) -> DataFrame:
    """``orders`` as JSON over several lines each, in one record per file.

    Finished orders lack their last bracket, pending ones have a comma too many; blocks end within the payloads.
    """
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/dumps/orders"), F.pmod(F.col("o_custkey"), F.lit(2)).cast("string"), F.lit(".log"))
    status = F.col("o_orderstatus")
    texts = F.array(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" {")),
        F.concat(F.lit('  "key": '), F.col("o_orderkey").cast("string"), F.lit(",")),
        F.concat(F.lit('  "status": "'), status, F.lit('", "note": "} ] \\" {",')),
        F.concat(F.lit('  "prices": ['), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit(",")),
        F.when(status == "P", "    2, ]").otherwise("    2]"),
        F.when(status == "F", "never closed").otherwise("} stored"),
    )
    body = orders.select(path.alias("file_path"), "o_orderkey", F.posexplode(texts).alias("part", "text")).select(
        "file_path", (F.col("o_orderkey") * 8 + F.col("part")).alias("seq"), "text")
    opening = orders.select(path.alias("file_path")).distinct().select(
        "file_path", F.lit(-1).cast("bigint").alias("seq"), F.lit(DUMP_START + "all orders").alias("text"))
    return body.unionByName(opening).withColumn("block", F.floor(F.col("seq") / block_seq))
