"""Registered queries: field extraction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import (
    BRACKET_ROWS, EVENT_LINES, EVENT_SCHEMA, THREAD_ROWS, event_fields, events, query, scratch, sql, then, write_files,
)
from lumberline.operators import extract
from lumberline.plans.blocks import SCHEMA_VERSION, Schema
from lumberline.plans.importers import PRESETS, schema_from_grok
from lumberline.sources import views

S = SparkSession


def _spread(frame: DataFrame, keys: list[str], **names: str) -> DataFrame:
    f: Column = F.col("fields")
    return frame.select(*keys, *[f[name].alias(out) for out, name in names.items()])


@query("X1_fields", sql("""SELECT l.file_path, l.line_no, st.stamp AS ts_text, st.lv AS lv, st.event_type AS kind, st.msg AS message
  FROM lines l LEFT JOIN st ON l.file_path = st.f AND l.seq = st.event_id * 4"""))
def fields(spark: S, sf_dir: str) -> DataFrame:
    return _spread(event_fields(spark, sf_dir), ["file_path", "line_no"], ts_text="Timestamp", lv="Level", kind="Kind", message="Message")


@query("X2_prefix", sql("""SELECT seq, stamp AS ts_text, CASE WHEN NOT broken THEN lv END AS lv,
  CASE WHEN broken THEN 'unreadable ' ELSE '' END || msg AS message FROM brk""", BRACKET_ROWS))
def prefix(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_fields(views.bracket_lines(spark, sf_dir), PRESETS["bracketed"])
    return _spread(found, ["seq"], ts_text="Timestamp", lv="Level", message="Message")


@query("X3_resync", sql("SELECT seq, stamp AS ts_text, thread, lv, msg AS message FROM thr", THREAD_ROWS))
def resync(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_fields(views.thread_lines(spark, sf_dir), PRESETS["classic"])
    return _spread(found, ["seq"], ts_text="Timestamp", thread="Thread", lv="Level", message="Message")


@query("X4_match_report", sql("""SELECT seq, CASE WHEN l_returnflag = 'R' THEN 'partial' ELSE 'full' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 3 ELSE 4 END AS matched_blocks, CASE WHEN l_returnflag = 'R' THEN 1 END AS skipped_from,
  CASE WHEN l_returnflag = 'R' THEN 2 END AS skipped_to, CASE WHEN l_returnflag = 'R' THEN thread END AS hole FROM thr""", THREAD_ROWS))
def report(spark: S, sf_dir: str) -> DataFrame:
    found = extract.match_report(views.thread_lines(spark, sf_dir), PRESETS["classic"])
    return found.select("seq", *[f"match.{c}" for c in ("status", "matched_blocks", "skipped_from", "skipped_to", "hole")])


@query("X5_coverage", sql("""SELECT file_path, count(*) FILTER (WHERE NOT broken) AS "full", count(*) FILTER (WHERE broken) AS partial,
  CAST(0 AS BIGINT) AS "none", CAST(0 AS BIGINT) AS blank FROM brk GROUP BY file_path""", BRACKET_ROWS))
def coverage(spark: S, sf_dir: str) -> DataFrame:
    return extract.schema_coverage(views.bracket_lines(spark, sf_dir), PRESETS["bracketed"], by=["file_path"])


@query("X6_infer_schema", sql("""SELECT count(*) FILTER (WHERE is_primary) AS "full", CAST(0 AS BIGINT) AS partial,
  count(*) FILTER (WHERE NOT is_primary) AS "none", CAST(0 AS BIGINT) AS blank,
  'Timestamp,Level,Thread,Source,Number,Message' AS names FROM lines"""))
def infer(spark: S, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    schema, _ = extract.infer_schema(log.where("is_primary"))
    return extract.schema_coverage(log, schema).withColumn("names", F.lit(",".join(schema.field_names)))


@query("X1_marked_fields", sql("SELECT seq, stamp AS ts_text, thread, lv, replace(msg, ' qty ', ' ' || chr(64977) || 'qty' || chr(64976) || ' ') AS message FROM thr", THREAD_ROWS))
def marked_fields(spark: S, sf_dir: str) -> DataFrame:
    """Lines that hold the characters matching works with."""
    lines = views.thread_lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" qty "), F.lit(" \ufdd1qty\ufdd0 ")))
    found = extract.extract_preset(lines, "classic")
    return _spread(found, ["seq"], ts_text="Timestamp", thread="Thread", lv="Level", message="Message")


GROK = r"%{TIMESTAMP_ISO8601:time} \[%{WORD:thread}\] %{LOGLEVEL:level} - %{GREEDYDATA:msg}"


@query("X7_grok", sql("""SELECT seq, stamp AS time, CASE WHEN l_returnflag <> 'R' THEN thread END AS thread, lv, msg AS message
  FROM thr WHERE l_returnflag <> 'R'""", THREAD_ROWS))
def grok(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_grok(views.thread_lines(spark, sf_dir), GROK)
    complete = F.col("fields.thread").isNotNull()
    return _spread(found.where(complete), ["seq"], time="time", thread="thread", lv="level", message="msg")


# All lines, also those that X7_grok leaves out: behind its time such a line is left over and becomes the message.
@query("X7_grok_all", sql("""SELECT seq, stamp AS time, CASE WHEN l_returnflag <> 'R' THEN thread END AS thread, CASE WHEN l_returnflag <> 'R' THEN lv END AS lv,
  CASE WHEN l_returnflag = 'R' THEN thread || ' ' || lv || ' - ' ELSE '' END || msg AS message,
  CASE WHEN l_returnflag = 'R' THEN 'partial' ELSE 'full' END AS status FROM thr""", THREAD_ROWS))
def grok_all(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_grok(views.thread_lines(spark, sf_dir), GROK)
    reported = extract.match_report(found, schema_from_grok(GROK)).withColumn("status", F.col("match.status"))
    f = F.col("fields")
    return reported.select("seq", f["time"].alias("time"), f["thread"].alias("thread"), f["level"].alias("lv"), f["msg"].alias("message"), "status")


@query("X8_log4j", sql("SELECT seq, stamp AS ts_text, thread, lv, msg AS message FROM thr", THREAD_ROWS))
def log4j(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_log4j(views.thread_lines(spark, sf_dir), "%d{ISO8601} [%t] %-5p - %m%n")
    return _spread(found, ["seq"], ts_text="Timestamp", thread="Thread", lv="Level", message="Message")


@query("X9_preset_pipe", """SELECT l_orderkey * 64 + l_linenumber AS seq, CAST(l_orderkey AS VARCHAR) AS a, l_returnflag AS b, l_linestatus AS c,
  ' part ' || l_partkey || ' qty ' || CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) AS message FROM lineitem""")
def pipe(spark: S, sf_dir: str) -> DataFrame:
    found = extract.extract_preset(views.pipe_lines(spark, sf_dir), "pipe")
    shown = _spread(found, ["seq"], a="Field 1", b="Field 2", c="Field 3", message="Message")
    return shown.withColumn("message", F.concat(F.lit(" "), F.col("message")))


_BEST = sql("""SELECT file_path, 'bracketed' AS name, count(*) FILTER (WHERE NOT broken) AS "full" FROM brk GROUP BY file_path
  UNION ALL SELECT '/logs/workers.log', 'classic', count(*) FILTER (WHERE l_returnflag <> 'R') FROM thr
  UNION ALL SELECT '/logs/items.log', 'pipe', count(*) FROM lineitem""", then(BRACKET_ROWS, THREAD_ROWS))


def _three_formats(spark: S, sf_dir: str) -> DataFrame:
    first, *rest = [view(spark, sf_dir) for view in (views.bracket_lines, views.thread_lines, views.pipe_lines)]
    for other in rest:
        first = first.unionByName(other)
    return first


@query("X10_best_schema", _BEST)
def best(spark: S, sf_dir: str) -> DataFrame:
    schemas = {n: PRESETS[n] for n in ("bracketed", "classic", "pipe")}
    return extract.best_schema(_three_formats(spark, sf_dir), schemas).select("file_path", "name", "full")


def _schema_file(schema: Schema) -> str:
    """A schema as a file of the newest version has it."""
    entries = [{
        "kind": b.kind, "name": b.name, "leadingText": b.leading, "closingText": b.closing, "separator": b.separator,
        "separatorIsRegex": b.separator_regex, "customRegex": b.pattern, "ignored": b.hidden,
    } for b in schema.blocks]
    return json.dumps({"version": SCHEMA_VERSION, "linePrefix": schema.line_prefix, "blocks": entries})


@query("X10_schema_folder", _BEST)
def schema_folder(spark: S, sf_dir: str) -> DataFrame:
    """The schemas come from a folder, in which some files are none: no JSON, of a later version, not applicable."""
    texts = {n: _schema_file(PRESETS[n]) for n in ("bracketed", "classic", "pipe")}
    texts |= {"torn": texts["pipe"][:40], "later": texts["pipe"].replace('"version": 3', '"version": 4'), "empty": '{"version": 3, "blocks": []}'}
    folder = scratch(spark, "schemas")
    write_files(spark.createDataFrame([(f"/{n}.json", 0, t) for n, t in texts.items()], "file_path string, seq int, data string"), folder)
    return extract.best_schema(_three_formats(spark, sf_dir), extract.load_schemas(spark, folder)).select("file_path", "name", "full")


@query("X11_project_view", sql("""SELECT l.file_path, l.line_no, CASE WHEN st.event_id IS NULL THEN l.text ELSE st.lv || ' ' || st.msg END AS shown
  FROM lines l LEFT JOIN st ON l.file_path = st.f AND l.seq = st.event_id * 4""", EVENT_LINES))
def project(spark: S, sf_dir: str) -> DataFrame:
    return extract.project_view(event_fields(spark, sf_dir), ["Message", "Level"]).select("file_path", "line_no", "shown")


@query("X12_typed_fields", """SELECT l_orderkey * 64 + l_linenumber AS seq, l_orderkey AS "Order", l_partkey AS "Part" FROM lineitem""")
def typed(spark: S, sf_dir: str) -> DataFrame:
    from lumberline.plans.blocks import Block, Schema

    schema = Schema((
        Block("integer", "Order", separator="|"), Block("text", "Flag", separator="|"), Block("text", "Status", separator="|"),
        Block("integer", "Part", leading="part", separator="qty"), Block("remainder", "Quantity"),
    ))
    found = extract.extract_fields(views.pipe_lines(spark, sf_dir), schema)
    return extract.typed_fields(found, schema).select("seq", "Order", "Part")


assert EVENT_SCHEMA.field_names == ["Timestamp", "Level", "Kind", "Message"]
